"""The queries opN_<name> of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, dartminhash, langid, licenses, mixing, nndescent, prefixtrie, quality, secrets, subword, suffixes, veccode
from .common import table, written

RANKS, VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def held_out(id_col: str = "doc_id"):
    """Documents that language ID must not learn from; a null id is one of them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = langid.learn(docs.where(~held_out()))
    return langid.identify(docs, learned).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), RANKS, PATTERN)
    hashed = encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return bpe.decode(hashed, RANKS).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = bpe.count_tokens(table(spark, sf_dir, "documents"), VOCABULARY, PATTERN)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn_order(docs)).drop("rejected_by")


def domain_of(source: str = "source"):
    """The tables name no domain; the sources are dealt to four by their number."""
    return F.concat(F.lit("d"), F.coalesce(F.expr(f"try_cast(regexp_extract({source}, '[0-9]+', 0) as int)") % 4, F.lit(0)).cast("string"))


#: Production parameters of op2: 60 % of all tokens, up to four epochs, the first domain wanted more than it supplies.
MIX = mixing.Plan(
    weights={"domain": {"d0": 1, "d1": 8, "d2": 2, "d3": 1}, "lang": {"en": 3, "de": 2, "fr": 2, "es": 4}, "source": {"src0": 1}},
    default=2, share=(3, 5), epochs=4, seed=17,
)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), MIX, domain_of())
    return mixed.select("doc_id", F.col("mix_domain").alias("domain"), "lang", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_copies").alias("copies"), F.col("mix_part").alias("part_tokens"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = nndescent.near_duplicates(table(spark, sf_dir, "embeddings"))
    return links.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.deduplicate(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["license"], x["start"], x["end"], x["changes"])), ",")
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["license"]))), ",")
    return found.select("doc_id", F.size("found").cast("long").alias("n_found"), names.alias("licenses"), spans.alias("spans"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = dartminhash.near_duplicates(table(spark, sf_dir, "documents"))
    return classes.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(secrets.BASE))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    books = veccode.learn(vectors)
    coded = written(veccode.compress(vectors, books, keep=["vec_id", "label"]), "vector-codes")
    found = veccode.with_label_error(coded)
    return found.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = written(prefixtrie.sequences(table(spark, sf_dir, "conversations")), "trie-turns")
    return prefixtrie.nodes(written(prefixtrie.rebuilt(seqs), "trie-paths"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = subword.learn(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = subword.score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_mixing": op2_mixing,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_token_counts": op4_token_counts,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_secret_scan": op9_secret_scan,
    "op10_quality_rules": op10_quality_rules,
    "op11_vector_codes": op11_vector_codes,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_quality_classifier": op13_quality_classifier,
}

def _secret_sql() -> str:
    """A regex splits a text into gaps; running sums of gap and match lengths place the matches."""

    def pattern(r):
        return "'" + r.regex.replace("'", "''") + "'"

    kinds = " UNION ALL ".join(
        f"""SELECT doc_id, '{r.kind}' AS kind, {k} AS rank, {r.least} AS least, regexp_extract_all(t, {pattern(r)}) AS m,
        regexp_extract_all(t, {pattern(r)}, {r.group}) AS p, string_split_regex(t, {pattern(r)}) AS g FROM d"""
        for k, r in enumerate(secrets.RULES)
    )
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE)
    base = f"rank < {len(secrets.BASE)}"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), k AS ({kinds}),
    e AS (SELECT doc_id, kind, rank, least, unnest(m) AS m, unnest(p) AS p, unnest(g[1:len(m)]) AS g, generate_subscripts(m, 1) AS i FROM k WHERE len(m) > 0),
    s AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS fin FROM e),
    f AS (SELECT doc_id, kind, rank, fin - length(m) AS start, fin, kind || ':' || CAST(fin - length(m) AS BIGINT) || ':' || CAST(fin AS BIGINT) AS label FROM s WHERE length(p) >= least),
    a AS (SELECT doc_id, {counts}, string_agg(label, ',' ORDER BY start, rank) AS spans, string_agg(label, ',' ORDER BY start, rank) FILTER ({base}) AS base FROM f GROUP BY doc_id)
    SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN a USING (doc_id)"""


def _share_sql(source: str, parents: str, name: str) -> str:
    """Siblings' budgets, in the order of cap / weight."""
    line = f"PARTITION BY {parents} ORDER BY cap / weight, {name}"
    return f"""SELECT *, CASE WHEN filled THEN cap ELSE greatest(pb - coalesce(sum(cap) FILTER (filled) OVER (PARTITION BY {parents}), 0), 0) * weight
        // sum(weight) FILTER (NOT filled) OVER (PARTITION BY {parents}) END AS budget FROM (SELECT *, cap * sum(weight) OVER ({line} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
        <= (pb - coalesce(sum(cap) OVER ({line} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS filled FROM ({source}))"""


def mix_sql(documents: str, plan: mixing.Plan) -> str:
    """CTEs that end in `mixed`: doc_id, domain, lang, source, n_tokens, copies, part_tokens of `documents` rows."""

    def weight(level: str) -> str:
        given = "".join(f" WHEN '{k}' THEN {v}" for k, v in plan.weights.get(level.split(".")[-1], {}).items())
        return f"CASE {level}{given} ELSE {plan.default} END" if given else str(plan.default)

    return f"""
    m AS (SELECT doc_id, 'd' || coalesce(TRY_CAST(regexp_extract(source, '[0-9]+') AS INT) % 4, 0) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM {documents}),
    leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS supply FROM m GROUP BY ALL),
    b1 AS ({_share_sql(f"SELECT 0 AS root, domain, CAST(sum(supply) * {plan.epochs} AS BIGINT) AS cap, {weight('domain')} AS weight, (SELECT CAST(sum(supply) AS BIGINT) FROM leaves) * {plan.share[0]} // {plan.share[1]} AS pb FROM leaves GROUP BY domain", "root", "domain")}),
    b2 AS ({_share_sql(f"SELECT l.domain, l.lang, l.cap, {weight('l.lang')} AS weight, CAST(b1.budget AS BIGINT) AS pb FROM (SELECT domain, lang, CAST(sum(supply) * {plan.epochs} AS BIGINT) AS cap FROM leaves GROUP BY ALL) l JOIN b1 USING (domain)", "domain", "lang")}),
    b3 AS ({_share_sql(f"SELECT l.domain, l.lang, l.source, supply, supply * {plan.epochs} AS cap, {weight('l.source')} AS weight, CAST(b2.budget AS BIGINT) AS pb FROM leaves l JOIN b2 USING (domain, lang)", "domain, lang", "source")}),
    p AS (SELECT domain, lang, source, CAST(CASE WHEN supply > 0 THEN budget // supply ELSE 0 END AS BIGINT) AS passes, CAST(CASE WHEN supply > 0 THEN budget % supply ELSE 0 END AS BIGINT) AS rest FROM b3),
    k AS (SELECT m.*, passes, rest, md5('{plan.seed}:' || passes || ':' || doc_id) || ':' || doc_id AS key FROM m JOIN p USING (domain, lang, source)),
    r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) AS fin FROM k),
    mixed AS (SELECT doc_id, domain, lang, source, n_tokens, passes + CASE WHEN fin <= rest THEN 1 ELSE 0 END AS copies,
        CAST(CASE WHEN fin > rest AND fin - n_tokens < rest THEN rest - (fin - n_tokens) ELSE 0 END AS BIGINT) AS part_tokens FROM r)"""


def _vector_code_sql() -> str:
    """One block of CTEs for each round: the nearest entry of every part, and the entries' means rounded down."""
    parts, entries = veccode.PARTS, veccode.ENTRIES
    assigned = """SELECT vec_id, part, pos_list, arg_min(entry, (dist, entry)) AS entry, min(dist) AS dist FROM (
        SELECT x.vec_id, x.part, x.vals AS pos_list, b.entry, list_sum(list_transform(list_zip(x.vals, b.vals), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM x JOIN {books} b USING (part))
        GROUP BY ALL"""
    ctes = f"""
    v AS (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * {veccode.SCALE}) AS BIGINT)) AS c FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
    x AS MATERIALIZED (SELECT vec_id, p.part, c[p.part * len(c) // {parts} + 1 : (p.part + 1) * len(c) // {parts}] AS vals FROM v, (SELECT unnest(range({parts})) AS part) p),
    seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT {entries}),
    b0 AS MATERIALIZED (SELECT part, entry, vals FROM x JOIN seeds USING (vec_id))"""
    for k in range(veccode.ROUNDS):
        ctes += f""",
    a{k} AS ({assigned.format(books=f"b{k}").replace("GROUP BY ALL", "GROUP BY vec_id, part, pos_list")}),
    s{k} AS (SELECT part, entry, i, CAST(sum(pos_list[i]) AS BIGINT) AS s, count(*) AS n FROM a{k}, (SELECT unnest(range(1, (SELECT max(len(vals)) FROM x) + 1)) AS i) GROUP BY ALL),
    m{k} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS vals FROM s{k} GROUP BY part, entry),
    b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{k}.vals, b{k}.vals) AS vals FROM b{k} LEFT JOIN m{k} USING (part, entry))"""
    last = f"b{veccode.ROUNDS}"
    return f"""WITH {ctes},
    f AS ({assigned.format(books=last).replace("GROUP BY ALL", "GROUP BY vec_id, part, pos_list")}),
    e AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM f GROUP BY vec_id)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
        (SELECT sha256(string_agg(array_to_string(vals, ','), ',' ORDER BY part, entry)) FROM {last}) AS codebooks_sha256 FROM e JOIN v USING (vec_id)"""


#: Every node is a row (depth, path) of its conversations; leaves and saved tokens go up along the smallest one's path.
#: The CRC-32 of an id's decimals is folded over its characters by the table of the polynomial.
_TRIE_SQL = r"""
    WITH z AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, b: xor(a >> 1, (a & 1) * 3988292384)) ORDER BY i) AS crc FROM (SELECT unnest(range(256)) AS i)),
    t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
    k AS (SELECT conv_id, sha256(octet_length(encode(role)) || ':' || role || text) AS key, len(regexp_extract_all(text, '[^ 	-
]+')) AS words, turn, role FROM t),
    o AS (SELECT conv_id, key, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, key) AS i FROM k),
    c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
        lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t), z),
    r AS (SELECT c.conv_id, i, key, words FROM c JOIN o USING (conv_id) WHERE i > h
        UNION ALL SELECT c.conv_id, i, key, words FROM c JOIN o ON o.conv_id = c.base WHERE i <= h),
    q AS (SELECT conv_id, key, words, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS depth FROM r),
    p AS (SELECT conv_id, depth, words, sha256(string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS path FROM q UNION ALL SELECT conv_id, 0, 0, '' FROM c),
    l AS (SELECT *, lag(path) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p),
    n AS (SELECT depth, path, any_value(parent) AS parent, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM l GROUP BY depth, path),
    k2 AS (SELECT depth - 1 AS depth, parent AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
    m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k2 USING (depth, path)),
    u AS (SELECT l.depth, l.path, sum(CASE WHEN m.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((m.n_convs - 1) * m.words) AS saved_tokens
        FROM m JOIN l ON l.conv_id = m.conv_id AND l.depth <= m.depth GROUP BY ALL)
    SELECT m.conv_id, m.depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
    FROM m JOIN u USING (depth, path) LEFT JOIN n up ON up.depth = m.depth - 1 AND up.path = m.parent"""

ORACLE_SQL: dict[str, str] = {
    "op11_vector_codes": _vector_code_sql(),
    "op12_prefix_trie": _TRIE_SQL,
    "op2_mixing": f"WITH {mix_sql('documents', MIX)} SELECT * FROM mixed WHERE copies > 0 OR part_tokens > 0",
    "op9_secret_scan": _secret_sql(),
}
