"""Files in and out: documents, question banks, catalogues, metrics, reports.

Every source reads a whole folder at once and returns its rows, and where rows can be bad a second DataFrame of rejects
with a reason, so that one bad row stops nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import pools
from ..shared import checkpointed

# Kinds of source files by extension.
SOURCE_KINDS = {"md": "markdown", "markdown": "markdown", "pdf": "pdf"}
# What reports of exam questions may say about themselves.
PROVENANCE = ("exact_reported", "reported_followup", "inferred_followup")
RELIABILITY = ("current", "historical_same_course", "adjacent_historical", "inferred")


def discover(spark: SparkSession, root: str, kinds: dict[str, str] = SOURCE_KINDS) -> DataFrame:
    """A1: source files below a folder: relative path, title, kind by extension, size and SHA-256. Contents stay in their tasks."""
    endings = ",".join(e for x in kinds for e in (x, x.upper()))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{endings}}}").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.create_map(*(F.lit(x) for p in kinds.items() for x in p))[F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))]
    title = F.trim(F.regexp_replace(F.regexp_replace(name, r"\.[^.]+$", ""), r"[_\-\s]+", " "))
    base = root.split("://")[-1].removeprefix("file:").rstrip("/") + "/"
    return files.select(F.substring_index("path", base, -1).alias("relative_path"), title.alias("title"), kind.alias("kind"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """A2: whole text files; bytes that are no UTF-8 become replacement characters."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def pages(df: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """A3: pages of a range; the filter reaches the scan."""
    if first is not None:
        df = df.where(F.col("page_number") >= first)
    return df.where(F.col("page_number") <= last) if last is not None else df


def json_bank(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A4: questions of JSON files, each a list or an object with a list named questions; one form (B16). With a schema the
    files are read once; without one Spark reads all of them in a few tasks first, to find it."""
    raw = (spark.read.schema(schema) if schema else spark.read).json(path, multiLine=True)
    if "questions" in raw.columns:
        # files of both forms may lie in one folder: what has no list is a question itself
        listed = raw.where("questions IS NOT NULL").select(F.explode("questions").alias("q")).select("q.*")
        own = [c for c in raw.columns if c != "questions"]
        plain = [c for c in own if c in ("question", "text", "wording")]
        raw = listed.unionByName(raw.where("questions IS NULL").select(*own), allowMissingColumns=True) if plain else listed
    return pools.normalized(raw)


def jsonl_bank(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """A5: questions of JSON lines, and rejects (path, line, reason). Line numbers count within each file."""
    # a file is read whole, so that its lines keep their numbers
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    rows = files.where(F.trim("line") != "").select("path", (F.col("pos") + 1).alias("line_no"), F.from_json("line", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("q"))
    bad = rows.where("q._corrupt_record IS NOT NULL OR q IS NULL").select("path", "line_no", F.lit("not a JSON object").alias("reason"))
    good = rows.where("q._corrupt_record IS NULL AND q IS NOT NULL").select("path", "line_no", "q.*").drop("_corrupt_record")
    return good, bad


def markdown_bank(files: DataFrame) -> DataFrame:
    """Questions of Markdown files (path, text): level-one headings name the topic of the level-two headings below."""
    rows = files.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    here = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = F.length(F.regexp_extract("line", r"^(#{1,2})\s+\S", 1))
    title = F.trim(F.regexp_replace("line", r"^#{1,2}\s+", ""))
    rows = rows.withColumn("topic", F.last(F.when(level == 1, title), ignorenulls=True).over(here)).withColumn("section", F.sum(F.when(level > 0, 1).otherwise(0)).over(here)).withColumn("heading", F.when(level == 2, title))
    blocks = rows.groupBy("path", "section").agg(
        F.max("heading").alias("heading"), F.coalesce(F.first("topic"), F.lit("Unassigned")).alias("topic"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("block"),
    ).where("heading IS NOT NULL")

    def field(label: str) -> Column:
        value = F.trim(F.regexp_extract("block", rf"(?i)\*\*{label}:\*\*[ \t]*([^\n]*)", 1))
        return F.when(value != "", value)

    def bullets(label: str) -> Column:
        block = F.regexp_extract("block", rf"(?i)\*\*{label}:\*\*[ \t]*\n((?:\s*[-*]\s+[^\n]+\n?)*)", 1)
        return F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*[-*]\s+", ""))), lambda x: x != "")

    split = r"^(.+?)\s+[—–-]\s+(.+)$"
    source, slides = field("Source"), r"(?i)^(.+?)\s+[—–-]\s+(?:slides?|pages?)\s+(.+)$"
    raw = blocks.select(
        F.when(F.col("heading").rlike(split), F.regexp_extract("heading", split, 1)).alias("id"), F.when(F.col("heading").rlike(split), F.regexp_extract("heading", split, 2)).otherwise(F.col("heading")).alias("question"), "topic",
        field("Priority").alias("priority"), field("Difficulty").alias("difficulty"), field("Type").alias("question_type"), F.when(source.rlike(slides), F.regexp_extract(source, slides, 1)).otherwise(source).alias("source_file"),
        F.when(source.rlike(slides), F.regexp_extract(source, slides, 2)).alias("source_slides"), bullets("Expected answer points").alias("expected_answer_points"), bullets("Possible examiner follow-ups?").alias("possible_followups"),
    )
    return pools.normalized(raw)


def reported_bank(spark: SparkSession, path: str, subjects: DataFrame, aliases: dict[str, str] | None = None, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Reported questions of bank files of schema 1.0 with their subject (id, slug), and rejects with a reason. A file is
    one bank, or, as exports are, has one on each line."""
    schema = "schema_version string, source_file string, questions array<struct<question_id:string, exam_id:string, wording:string, provenance:string, reliability:string, question_type:string, activation_status:string, answerability_status:string, chain_id:string, topic_tags:array<string>, required_actions:array<string>, current_course_evidence_ids:array<bigint>>>"
    raw = spark.read.schema(schema).json(path, multiLine=not lines)
    rows = raw.select("schema_version", "source_file", F.explode_outer("questions").alias("q")).select("schema_version", "source_file", "q.*")
    slug = F.trim("exam_id")
    if aliases:
        slug = F.coalesce(F.create_map(*(F.lit(x) for p in aliases.items() for x in p))[slug], slug)
    rows = rows.withColumn("slug", slug).join(subjects.select(F.col("id").alias("subject_id"), "slug"), "slug", "left")
    reason = (
        F.when(F.coalesce("schema_version", F.lit("")) != "1.0", "schema version").when(F.coalesce(F.trim("question_id"), F.lit("")) == "", "no id").when(F.coalesce(F.trim("wording"), F.lit("")) == "", "no wording")
        .when(F.col("subject_id").isNull(), "no such exam").when(~F.coalesce(F.col("provenance").isin(*PROVENANCE), F.lit(False)), "provenance").when(~F.coalesce(F.col("reliability").isin(*RELIABILITY), F.lit(False)), "reliability")
    )
    rows = rows.withColumn("reason", reason)
    return rows.where("reason IS NULL").drop("reason"), rows.where("reason IS NOT NULL").select("source_file", "question_id", "reason")


def export_reported(reported: DataFrame, path: str, per_bank: int = 500) -> None:
    """Reports (subject_id, question_id and more fields of A8) as banks of about `per_bank` questions, one on each line, in
    folders by subject, with the rules that go with them. A8 reads them back.

    A subject's reports are dealt to banks by a hash of their ids, as many as their number asks for, so that no bank grows
    with its subject.
    """
    rules = F.struct(F.lit(False).alias("reports_are_authoritative_for_answers"), F.lit(True).alias("require_current_course_evidence_for_activation"))
    banks = reported.groupBy("subject_id").agg(F.ceil(F.count(F.lit(1)) / per_bank).alias("banks"))
    fields = [F.col(c) for c in reported.columns if c not in ("subject_id", "source_file")]
    rows = reported.join(banks, "subject_id").withColumn("bank", F.pmod(F.xxhash64("question_id"), F.col("banks")))
    grouped = rows.groupBy("subject_id", "bank").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("questions"))
    source = F.concat(F.lit("export-"), F.col("subject_id").cast("string"), F.lit("-"), F.col("bank").cast("string"))
    grouped.select("subject_id", F.lit("1.0").alias("schema_version"), source.alias("source_file"), rules.alias("rules"), "questions").write.mode("overwrite").partitionBy("subject_id").json(path)


def catalogue(lines: DataFrame) -> DataFrame:
    """A10: numbered questions of catalogue texts (doc_id, line_no, line): a number at a line's start opens a question, the
    lines below belong to it; page numbers and marks are left out."""
    number = F.regexp_extract("line", r"^\s*(\d{1,3})[.)]\s+\S", 1).try_cast("int")
    rows = lines.where(~X.noise_line(F.col("line"))).withColumn("number", number)
    rows = rows.withColumn("part", F.sum(F.col("number").isNotNull().cast("int")).over(Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("part > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: F.regexp_replace(x["line"], r"^\s*\d{1,3}[.)]\s+", "")), " ")
    return rows.groupBy("doc_id", "part").agg(F.max("number").alias("number"), X.clean_question(text).alias("question")).drop("part")


def write_catalogue(questions: DataFrame, path: str) -> None:
    questions.write.mode("overwrite").option("header", "true").csv(f"{path}/csv")
    questions.write.mode("overwrite").json(f"{path}/json")


#: One schema of a call for A11, M10 and N5, by the log's own names: created_at, cache_hit, total_duration_ms, prompt_tokens,
#: tokens_per_second, model. Logs carry no ids; one is taken where a line has it.
METRIC_LOG = "id bigint, created_at timestamp, cache_hit boolean, total_duration_ms double, prompt_tokens bigint, tokens_per_second double, model string"


def metrics(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Inference metrics of JSON lines, as a table or as a stream; lines that do not parse are skipped.

    A call that does not say so was not cached; what else a line does not tell is null.
    """
    reader = (spark.readStream if stream else spark.read).schema(METRIC_LOG).option("mode", "DROPMALFORMED")
    rows = reader.json(path)
    return rows.select(
        "id", "created_at", F.coalesce("cache_hit", F.lit(False)).alias("cached"), F.col("total_duration_ms").alias("latency_ms"), "prompt_tokens", "tokens_per_second", "model"
    )


def write_report(report: DataFrame, path: str, key: str = "subject_id") -> None:
    """A report in folders by subject; subjects that are written again are replaced, the others stay."""
    report.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def upsert(updates: DataFrame, path: str, keys: list[str], partition: str, order: list[str], where: str = "true") -> DataFrame:
    """A13 in a stored table: INSERT ... ON CONFLICT (partition, keys) DO UPDATE WHERE, on Parquet in folders by `partition`.

    Of several updates of a key the last by `order` counts. `where` may speak of `old` and `new`: a stored row stays where
    it does not hold, or where nothing would change. Only folders in which a row comes in or changes are written, so the
    same batch again writes nothing. What is written is checkpointed first, as it is read from where it goes; a job that
    fails leaves the folders as they were. Returns the folders written with their counts (partition, inserted, updated).
    """
    spark, columns, at = updates.sparkSession, updates.columns, [partition, *keys]
    last = F.row_number().over(Window.partitionBy(*at).orderBy(*(F.desc(c) for c in order)))
    new = checkpointed(updates.withColumn("__k", last).where("__k = 1").drop("__k"))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    old = spark.read.schema(updates.schema).parquet(path) if there else new.limit(0)
    old = old.select(*columns).join(new.select(partition).distinct(), partition, "left_semi")
    row = F.struct(*columns)
    pairs = old.select(*at, row.alias("old")).join(new.select(*at, row.alias("new")), at, "full")
    changes = F.col("old").isNotNull() & F.col("new").isNotNull() & ~F.col("old").eqNullSafe(F.col("new")) & F.coalesce(F.expr(where), F.lit(False))
    action = F.when(F.col("old").isNull(), "inserted").when(changes, "updated").otherwise("kept")
    pairs = checkpointed(pairs.select(partition, action.alias("action"), F.when(action == "kept", F.col("old")).otherwise(F.col("new")).alias("row")))
    written = pairs.groupBy(partition).agg(F.count_if(F.col("action") == "inserted").alias("inserted"), F.count_if(F.col("action") == "updated").alias("updated")).where("inserted + updated > 0")
    written = checkpointed(written)
    rows = pairs.join(written.select(partition), partition, "left_semi").select("row.*")
    if not written.isEmpty():
        rows.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return written


def upsert_stream(updates: DataFrame, path: str, checkpoint: str, keys: list[str], partition: str, order: list[str], where: str = "true"):
    """A13 fed by a stream: each micro-batch is upserted; a batch that comes again after a failure changes nothing more.
    Returns the writer, to be triggered and started by the caller."""
    return updates.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: upsert(batch, path, keys, partition, order, where))
