"""More registered queries: functions, lookups, registry, jobs, builds and landed files on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.functions import timing
from vellum.operators import captions, evaluation, jobs, ledger, lineage, metrics, registry, splits
from vellum.sources import listings, sinks, wav
from vellum.streaming import live

from .bindings import BUILD, CORPUS, RATIOS, SQL_RECORDINGS, SQL_SYNC, landing, recordings, rejections, stored, table
from .bindings import ledger as ledger_rows
from .queries import _SPLIT_SQL, query


AT = "1996-01-01 00:00:00"
#: A landed payload holds the recordings of one language among a thousand identifiers.
_PART = "concat_ws('-', lang, floor(doc_id / 1000)) AS part"

# --- landed listings ---------------------------------------------------------------------


def _landed(rows: DataFrame, folder: str) -> str:
    """One JSON object a file."""
    rows.repartition("part").write.partitionBy("part").json(folder)
    return f"{folder}/*/"


@query(
    """SELECT doc_id AS recording_id, CASE WHEN doc_id % 3 = 0 THEN 'path/' || doc_id ELSE 'audio/' || doc_id END AS audio_path, length(trim(regexp_replace(replace(nfc_normalize(text), '\\n', ' '), '\\s+', ' ', 'g'))) AS n_text,
    n_chars / 1000 AS quality_score FROM documents"""
)
def export_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports landed as JSON, a corpus a file, and an empty listing beside them."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("//path/"), "doc_id")
    one = F.struct(
        F.col("doc_id").alias("recording_id"), F.concat("doc_id", F.lit(".wav")).alias("file"), path.alias("original_path"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("/audio/"), "doc_id")).otherwise("").alias("audio_url"), "text",
        (F.col("n_chars") / 100).alias("duration"), (F.col("n_chars") / 1000).alias("quality_score"), F.col("doc_id").alias("speaker_id"),
    )
    payload = d.groupBy(F.expr(_PART)).agg(F.collect_list(one).alias("recordings")).select("part", F.struct(F.lit(1).alias("id"), F.lit("text").alias("type")).alias("corpus"), "recordings")
    none = spark.sql("SELECT 'none' AS part, 'No recordings found for this corpus' AS error")
    export = listings.read_export(spark, _landed(payload.unionByName(none, allowMissingColumns=True), landing(spark, "export")))
    return listings.entries(export).select("recording_id", "audio_path", F.length("text").cast("long").alias("n_text"), "quality_score")


@query("SELECT doc_id AS recording_id, CASE WHEN length(source) > 0 THEN ltrim(source, '/') END AS audio_path, n_chars / 1000 AS quality_score FROM documents")
def manifest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export without identifiers, joined by name with a landed manifest that has them."""
    d = table(spark, sf_dir, "documents")
    name = F.format_string("%08d.wav", "doc_id")
    files = d.groupBy(F.expr(_PART)).agg(F.collect_list(F.struct(F.col("doc_id").alias("id"), F.concat(F.lit("/"), "source").alias("source_path"), name.alias("export_name"))).alias("files"))
    manifest = listings.read_manifest(spark, _landed(files, landing(spark, "manifest")))
    export = d.select(F.lit(None).cast("long").alias("recording_id"), name.alias("file"), "text", (F.col("n_chars") / 1000).alias("quality_score"), F.lit(None).cast("variant").alias("speaker_id"))
    return listings.entries_from_manifest(export, manifest).select("recording_id", "audio_path", "quality_score")


@query("SELECT doc_id, doc_id % 4 = 0 AS empty FROM documents")
def empty_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    k = F.col("doc_id") % 4
    body = F.when(k == 0, '{"error": "No recordings found"}').when(k == 1, '{"error": "server broke"}').when(k == 2, "<html>").otherwise('{"error": "no recordings found"}')
    return d.select("doc_id", listings.empty_listing(F.when(k == 3, 500).otherwise(404), body).alias("empty"))


# --- builds, versions and files -------------------------------------------------------------


@query(_SPLIT_SQL + " SELECT recording_id, speaker_id, n_chars FROM split WHERE split = 'dev'")
def built_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A build written by split, its manifest and, last, its metadata; one split read back."""
    rows = splits.with_split(recordings(spark, sf_dir), RATIOS).select("recording_id", "speaker_id", "n_chars", "split")
    root = landing(spark, "builds")
    sinks.write_version(rows, rows.select("recording_id", "split"), {"seed": 42}, root, "v1")
    if not sinks.committed(spark, f"{root}/v1") or sinks.write_version(rows, rows, {}, root, "v1"):
        raise RuntimeError("a build must be written once")
    listings.require_splits(spark, f"{root}/v1/rows")
    return listings.read_split(spark, f"{root}/v1/rows", "dev").select("recording_id", "speaker_id", "n_chars")


@query(f"WITH {SQL_SYNC} SELECT recording_id, nullif(speaker_id, '') AS speaker_id, length(text) AS n_text, text_hash, duration FROM ledger WHERE status = 'active'")
def build_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(ledger_rows(spark, sf_dir).select(*BUILD), "ledger")
    return ledger.build_rows(rows, rows.select("audio_sha256"), CORPUS).select("recording_id", "speaker_id", F.length("text").cast("long").alias("n_text"), "text_hash", "duration")


@query("SELECT doc_id, n_chars % 50 AS num_samples, 8000 AS rate, (n_chars % 50) / 8000 AS seconds, CASE WHEN n_chars % 50 > 3 THEN [0.25::DOUBLE, 0.375::DOUBLE] ELSE [] END AS part FROM documents")
def wav_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples k / 8 written as WAV bytes, their header, duration and a range read back."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 50).alias("n"))
    values = F.expr("transform(if(n > 0, sequence(0, cast(n - 1 as int)), cast(array() as array<int>)), k -> cast(k % 8 / 8 as float))")
    rows = d.select("doc_id", "n", wav.encoded(values, 8000).alias("content")).select("doc_id", "n", "content", wav.header(F.col("content")).alias("h"))
    part = F.when(F.col("n") > 3, wav.samples(F.col("content"), F.col("h"), F.lit(2), F.lit(4))).otherwise(F.array().cast("array<float>")).cast("array<double>")
    return rows.select("doc_id", F.col("h.num_samples").alias("num_samples"), F.col("h.rate").alias("rate"), wav.duration(F.col("h")).alias("seconds"), part.alias("part"))


@query("SELECT doc_id, (n_chars % 50) // 8 AS frames, CASE WHEN n_chars % 50 >= 8 THEN round(sqrt(140 / 64 / 8), 6) END AS level FROM documents")
def frame_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 50).alias("n"))
    values = F.expr("transform(if(n > 0, sequence(0, cast(n - 1 as int)), cast(array() as array<int>)), k -> cast(k % 8 / 8 as float))")
    levels = d.select("doc_id", wav.frame_levels(values, 8).alias("l"))
    return levels.select("doc_id", F.size("l").cast("long").alias("frames"), T.rounded(F.get("l", F.lit(0)), 6).alias("level"))


@query("SELECT o_custkey AS version, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'superseded' WHEN bool_or(o_orderstatus = 'F') AND bool_or(o_orderstatus = 'O') THEN 'built' ELSE 'partial' END AS state FROM orders GROUP BY o_custkey")
def version_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("version"), F.when(s == "P", "SUPERSEDED.json").when(s == "F", "build_metadata.json").otherwise("manifest.json").alias("file"))
    return lineage.built_states(files)


@query("SELECT o_orderkey AS run, 'checkpoint-' || o_custkey AS name FROM orders WHERE o_orderkey % 3 = 0 AND o_orderstatus = 'F'")
def old_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("checkpoint-"), "o_custkey")).when(F.col("o_orderkey") % 3 == 1, "checkpoint-last").otherwise("final")
    return lineage.old_checkpoints(o.select(F.col("o_orderkey").alias("run"), name.alias("name")), o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("run")))


@query("SELECT DISTINCT md5(text) AS sha256 FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 5 = 0 AND text IS NOT NULL)")
def new_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5("text").alias("sha256"))
    return sinks.new_contents(files, files.where("doc_id % 5 = 0")).select("sha256")


# --- lookups ------------------------------------------------------------------------------------


@query(f"WITH {SQL_SYNC} SELECT recording_id, status FROM ledger WHERE recording_id = 39 UNION ALL SELECT recording_id, 'rejected' FROM rejections WHERE recording_id = 41")
def point_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = ledger.recording(ledger_rows(spark, sf_dir), 39).select("recording_id", "status")
    return one.unionByName(ledger.rejection(rejections(spark, sf_dir), 41).select("recording_id", F.lit("rejected").alias("status")))


@query(f"WITH {SQL_SYNC} SELECT recording_id, (SELECT count(*) FROM rejections) AS rejected FROM rejections")
def rejected_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = rejections(spark, sf_dir).select("recording_id", "corpus_id")
    return ledger.rejected_ids(bad, CORPUS).join(F.broadcast(ledger.rejected_count(bad, CORPUS)), F.lit(True))


@query("SELECT doc_id AS recording_id, text, 'active' AS status, NULL::VARCHAR AS validated_at FROM documents")
def ledger_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("recording_id"), "text", F.lit("active").alias("status"))
    return ledger.migrated(old, 1).select("recording_id", "text", "status", "validated_at")


# --- scalar functions -----------------------------------------------------------------------------


@query(
    r"""SELECT event_id, strftime(make_timestamp((epoch_us(ts) // 1000 + floor(value)::BIGINT) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso,
    CASE WHEN event_id % 3 = 0 THEN '2024-05-01T10:00:00+02:00' ELSE '2024-05-01T10:00:00Z' END AS repaired, CASE WHEN event_id % 3 = 0 THEN 8 ELSE 10 END AS hour, CASE WHEN event_id % 4 <> 1 THEN value + 1 END AS seconds, 5 + (event_id - 100) / 16000 AS wall FROM events"""
)
def time_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    stamp = timing.repair_offset(F.when(k % 3 == 0, " 2024-05-01T10:00:00 02:00").otherwise("2024-05-01T10:00:00Z"))
    given = F.when(k % 4 == 0, (F.col("value") + 1).cast("string")).when(k % 4 == 1, F.when(k % 8 == 1, "-1").otherwise("x")).otherwise((F.col("value") + 1).cast("string"))
    at = (F.unix_millis(F.col("ts").cast("timestamp")) + F.floor("value")) / 1000
    return e.select("event_id", timing.iso_ms(at).alias("iso"), stamp.alias("repaired"), F.hour(timing.parse_start_time(stamp)).alias("hour"), timing.parse_duration(given).alias("seconds"), timing.wall_time(k, F.lit(100), F.lit(5.0), 16_000).alias("wall"))


_TOKENS = r"list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '')"


@query(
    rf"""SELECT conv_id, turn, role, CASE WHEN len(w) = 0 THEN '' ELSE list_reduce(w, lambda t, x: CASE WHEN instr('.,!?;:%)]}}»”', left(x, 1)) > 0 OR instr('([{{«“', right(t, 1)) > 0 THEN t || x ELSE t || ' ' || x END) END AS joined
    FROM (SELECT *, {_TOKENS} AS w FROM conversations WHERE text IS NOT NULL)"""
)
def joined_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("text is not null").withColumn("w", F.split(F.trim(F.regexp_replace("text", "\\s+", " ")), " "))
    return c.select("conv_id", "turn", "role", timing.join_words("w").alias("joined"))


@query(
    r"""WITH n AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'con.txt' WHEN page_id % 7 = 1 THEN '...' ELSE regexp_extract(replace(url, '\', '/'), '([^/]*)/*$', 1) END AS b FROM pages),
    m AS (SELECT page_id, right(regexp_replace(regexp_replace(b, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 100) AS p FROM n)
    SELECT page_id, CASE WHEN p = '' THEN 'upload' WHEN regexp_matches(p, '(?i)^(con|prn|aux|nul|com[0-9]|lpt[0-9])(\.|$)') THEN '_' || p ELSE p END AS name FROM m"""
)
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 7
    return table(spark, sf_dir, "pages").select("page_id", T.safe_name(F.when(k == 0, "a/con.txt").when(k == 1, "...").otherwise(F.col("url"))).alias("name"))


@query("SELECT event_id, left(event_type || ': ' || left(props, 20), 300) AS error, 'no ' || event_type || '.wav in x' AS scrubbed FROM events")
def error_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    path = F.concat(F.lit("no /srv/data/"), "event_type", F.lit(".wav in /a/x"))
    return e.select("event_id", T.described(F.col("event_type"), F.left("props", F.lit(20))).alias("error"), T.base_names(path).alias("scrubbed"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN round((o_totalprice - o_custkey) / o_totalprice, 6) END AS better, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice ELSE o_custkey END AS duration,
    CASE WHEN o_orderkey % 4 = 0 THEN greatest(0, o_totalprice - coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END, 0)) ELSE greatest(0, o_custkey - coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END, 0)) END AS left_over FROM orders"""
)
def job_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, price, small = F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_custkey").cast("double")
    length = jobs.job_duration(F.when(k % 4 == 0, price), small)
    return table(spark, sf_dir, "orders").select("o_orderkey", T.relative_improvement(F.when(k % 5 != 0, small), price).alias("better"), length.alias("duration"), jobs.remaining(length, F.when(k % 3 == 0, small)).alias("left_over"))


@query(
    r"""WITH p AS (SELECT conv_id AS job, turn AS index, CASE WHEN lag(turn) OVER w = turn - 1 THEN lag(text) OVER w END AS t FROM (SELECT conv_id, turn, regexp_replace(text, '[^a-z]+', ' ', 'g') AS text FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    q AS (SELECT job, index, trim(coalesce(t, '')) AS t FROM p), r AS (SELECT job, index, t, right(t, 30) AS e FROM q),
    s AS (SELECT job, index, trim(CASE WHEN length(t) > 30 AND left(right(t, 31), 1) <> ' ' THEN regexp_replace(e, '^\S+\s?', '') ELSE e END) AS e FROM r)
    SELECT job, index, CASE WHEN e = '' THEN 'names' ELSE 'names ' || e END AS prompt FROM s"""
)
def chunk_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("job"), F.col("turn").alias("index"), F.regexp_replace("text", "[^a-z]+", " ").alias("text"))
    return evaluation.chunk_prompts(c, F.lit("names"), 30).select("job", "index", "prompt")


@query(
    """SELECT event_id, value + 10 AS start, value + 11 AS "end", trim(event_type) AS text, ['b', 'a'] AS words, value + 10 AS first_start FROM events"""
)
def shifted_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments moved in time, and their words in order of their start."""
    word = lambda t, at: F.struct(at.alias("start"), (at + 0.5).alias("end"), F.lit(t).alias("text"))
    one = F.struct(F.col("value").alias("start"), (F.col("value") + 1).alias("end"), F.concat(F.lit(" "), "event_type", F.lit(" ")).alias("text"), F.array(word("a", F.col("value") + 0.5), word("b", F.col("value"))).alias("words"))
    rows = table(spark, sf_dir, "events").select("event_id", F.array(one).alias("s"), F.lit(10.0).alias("o"))
    rows = rows.select("event_id", captions.with_offset("s", "o").alias("s")).select("event_id", "s", captions.collected_words("s").alias("w"))
    return rows.select("event_id", F.col("s")[0]["start"].alias("start"), F.col("s")[0]["end"].alias("end"), F.col("s")[0]["text"].alias("text"), F.transform("w", lambda x: x["text"]).alias("words"), F.col("w")[0]["start"].alias("first_start"))


@query(
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'unknown mode' WHEN 1 THEN 'url and token are for push only' WHEN 2 THEN 'url is missing' WHEN 3 THEN 'url is not allowed' WHEN 4 THEN 'token is not valid' END AS error FROM events"""
)
def delivery_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 6
    mode = F.when(k == 0, "mail").when(k > 1, "push")
    url = F.when(k == 1, "https://a.example.com/x").when(k == 3, "https://evil.test/x").when(k > 3, "https://a.example.com/x")
    token = F.when(k == 4, " t ").when(k == 5, "t")
    return table(spark, sf_dir, "events").select("event_id", live.delivery_error(mode, url, token, ["*.example.com"]).alias("error"))


# --- registry -----------------------------------------------------------------------------------------


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("m"), (F.col("o_custkey") % 50).cast("string")).alias("name"), F.col("o_orderkey").cast("string").alias("version"), F.col("o_orderdate").cast("string").alias("created_at"), (F.col("o_orderstatus") == "F").alias("passed"))


_VERSIONS = "v AS (SELECT 'm' || (o_custkey % 50) AS name, o_orderkey::VARCHAR AS version, o_orderdate AS created_at, o_orderstatus = 'F' AS passed FROM orders), c AS (SELECT name, max(version) AS version FROM v WHERE name <> 'm7' GROUP BY name)"


def _current(versions: DataFrame) -> DataFrame:
    return versions.where("name <> 'm7'").groupBy("name").agg(F.max("version").alias("version"))


@query(f"WITH {_VERSIONS} SELECT v.name, string_agg(v.version, ',' ORDER BY v.created_at, v.version) AS versions, any_value(c.version) AS current FROM v LEFT JOIN c USING (name) GROUP BY v.name")
def registry_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _versions(spark, sf_dir)
    return registry.listing(v, _current(v)).select("name", F.array_join("versions", ",").alias("versions"), "current")


@query(f"WITH {_VERSIONS} SELECT name, version, passed FROM v JOIN c USING (name, version) WHERE name = 'm3' UNION ALL SELECT name, version, passed FROM v WHERE name = 'm4' AND version = '1'")
def registry_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _versions(spark, sf_dir)
    both = registry.detail(v, _current(v), "m3").unionByName(registry.detail(v, _current(v), "m4", "1"))
    return both.select("name", "version", "passed")


@query(
    f"""WITH {_VERSIONS}, s AS (SELECT DISTINCT CASE WHEN o_custkey % 3 = 0 THEN 'registry:m' || (o_custkey % 50) WHEN o_custkey % 3 = 1 THEN 'registry:m' || (o_custkey % 50) || '@5' ELSE 'file' || (o_custkey % 50) END AS spec,
        CASE WHEN o_custkey % 3 < 2 THEN 'm' || (o_custkey % 50) END AS name, CASE WHEN o_custkey % 3 = 1 THEN '5' END AS wanted FROM orders)
    SELECT spec, s.name, coalesce(wanted, c.version) AS version, CASE WHEN s.name IS NULL THEN spec WHEN coalesce(wanted, c.version) IS NOT NULL THEN s.name || '@' || coalesce(wanted, c.version) END AS label FROM s LEFT JOIN c ON c.name = s.name"""
)
def registry_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("o_custkey") % 3, F.concat(F.lit("m"), (F.col("o_custkey") % 50).cast("string"))
    spec = F.when(k == 0, F.concat(F.lit("registry:"), name)).when(k == 1, F.concat(F.lit("registry:"), name, F.lit("@5"))).otherwise(F.concat(F.lit("file"), (F.col("o_custkey") % 50).cast("string")))
    return registry.resolved(table(spark, sf_dir, "orders").select(spec.alias("spec")).distinct(), _current(_versions(spark, sf_dir)))


@query(f"WITH {_VERSIONS} SELECT name, version FROM c WHERE name <> 'm3' UNION ALL SELECT 'm3', min(version) FROM v WHERE name = 'm3' AND passed")
def registry_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _versions(spark, sf_dir)
    version = v.where("name = 'm3' and passed").agg(F.min("version")).first()[0]
    pointers = _current(v).selectExpr("name", "version", "'x' as promoted_at", "'y' as promoted_by", "false as forced")
    return registry.promoted(pointers, v, "m3", version, "now").select("name", "version")


@query(f"WITH {_VERSIONS} SELECT name, count(*) + CASE WHEN name = 'm1' THEN 1 ELSE 0 END AS n FROM v GROUP BY name")
def registry_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _versions(spark, sf_dir)
    new = spark.sql("SELECT 'm1' AS name, 'new' AS version, '2030-01-01' AS created_at, true AS passed")
    return registry.registered(v, new).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'base' END AS base_model, nullif(o_orderpriority, '') AS dataset_version, ['b'] AS kept, ['a'] AS given FROM orders")
def registry_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("o_orderkey") % 2 == 0
    gate = F.struct(F.when(even, F.col("o_orderstatus")).otherwise("").alias("base_model"), F.lit(None).cast("string").alias("dataset_version"))
    training = F.struct(F.lit("base").alias("base_model"), F.col("o_orderpriority").alias("dataset_version"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", gate.alias("gate"), training.alias("training"), F.create_map(F.lit("a"), F.repeat(F.lit("x"), F.lit(3000)), F.lit("b"), F.lit("1")).alias("m"), F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit(None).cast("string")).alias("o"))
    meta = registry.metadata("gate", "training")
    return rows.select("o_orderkey", meta["base_model"].alias("base_model"), meta["dataset_version"].alias("dataset_version"), F.map_keys(registry.trimmed(F.col("m"))).alias("kept"), F.map_keys(registry.given(F.col("o"))).alias("given"))


# --- jobs ------------------------------------------------------------------------------------------------


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(s == "O", "queued").when(s == "P", "running").otherwise("completed").alias("status"), F.col("o_orderdate").alias("created_at"), F.concat(F.lit("c"), "o_custkey").alias("client_ref"),
        F.when(F.col("o_orderkey") % 13 != 0, T.rounded("o_totalprice", 1)).alias("duration"), F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), F.lit(None).cast("timestamp").alias("updated_at"), F.lit(0.0).alias("current_seconds"), F.lit(None).cast("string").alias("phase"),
    )


_JOBS = "j AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'completed' END AS status, o_custkey, o_orderdate, CASE WHEN o_orderkey % 13 <> 0 THEN round(o_totalprice, 1) END AS duration FROM orders)"


@query(f"WITH {_JOBS} SELECT count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'running') AS running, round(sum(duration) FILTER (status = 'queued'), 1) AS queued_seconds, count(*) FILTER (status <> 'completed' AND duration IS NULL) AS unknown_duration FROM j")
def queue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.queue_summary(_jobs(spark, sf_dir))


@query(f"WITH {_JOBS} SELECT id FROM j WHERE o_custkey = 7 AND status = 'queued'")
def job_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.listed(_jobs(spark, sf_dir), "c7", "queued").select("id")


@query(f"WITH {_JOBS} SELECT id, CASE status WHEN 'running' THEN 'queued' ELSE status END AS status, CASE WHEN id % 2 = 0 THEN 5.5 ELSE 0 END::DOUBLE AS current_seconds, CASE WHEN id % 2 = 0 THEN 'decode' END AS phase, id % 2 = 0 AS touched FROM j")
def job_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a restart, some jobs changed."""
    rows = jobs.recovered(_jobs(spark, sf_dir))
    changes = rows.where("id % 2 = 0").select("id", F.lit(5.5).alias("current_seconds"), F.lit("decode").alias("phase"))
    return jobs.updated(rows, changes, F.lit(AT).cast("timestamp")).select("id", "status", "current_seconds", "phase", F.col("updated_at").isNotNull().alias("touched"))


@query(f"WITH {_JOBS} SELECT id, CASE id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'queued' ELSE 'failed' END AS status, id % 3 = 0 AS started, id % 3 = 2 AS finished, CASE WHEN id % 3 = 2 THEN 'broke' END AS error FROM j")
def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, out = _jobs(spark, sf_dir), None
    for k, (status, error) in enumerate((("running", None), ("queued", None), ("failed", "broke"))):
        part = jobs.with_status(rows.where(F.col("id") % 3 == k), status, F.lit(AT).cast("timestamp"), error)
        out = part if out is None else out.unionByName(part)
    return out.select("id", "status", F.col("started_at").isNotNull().alias("started"), F.col("finished_at").isNotNull().alias("finished"), "error")


@query(
    """WITH j AS (SELECT o_orderkey AS id, o_orderstatus AS s, o_orderkey % 4 AS k FROM orders)
    SELECT id, CASE s WHEN 'F' THEN 'failed' ELSE 'running' END AS status, CASE k WHEN 3 THEN 100.0 ELSE round(k * 100 / 3, 1) END AS progress, k * 10.0 AS current_seconds, k AS chunks_done,
        CASE WHEN s = 'F' THEN NULL WHEN k = 3 THEN 0.0 WHEN k > 0 THEN round(greatest(1.0, 100 / (k * 10) * (30 - k * 10) - 10), 1) END AS eta_seconds, format('{:5.1f} %', CASE k WHEN 3 THEN 100.0 ELSE k * 100 / 3 END) AS line FROM j"""
)
def job_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    k = (F.col("o_orderkey") % 4).cast("double")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("running").alias("status"), F.array(F.lit(10.0), F.lit(20.0), F.lit(30.0)).alias("ends"), (k * 10).alias("current"), F.lit(30.0).alias("total_seconds"), at.alias("started"), (at + F.expr("interval 100 seconds")).alias("updated"), F.lit(0).alias("baseline"), (k * 100 / 3).alias("percent")
    )
    seen = jobs.views(rows, at + F.expr("interval 110 seconds"))
    line = jobs.progress_line(F.lit(""), F.when(F.col("percent") > 99, 100.0).otherwise(F.col("percent")), F.lit(None).cast("double"))
    return seen.join(rows.select("id", F.ltrim(line).alias("_l"), line.alias("l")), "id").select("id", "status", "progress", "current_seconds", F.col("chunks_done").cast("long").alias("chunks_done"), "eta_seconds", F.substring("l", 2, 100).alias("line"))


@query(
    """WITH b AS (SELECT doc_id, n_chars, unnest(generate_series(500, n_chars - 1, 500)) AS x FROM documents), o AS (SELECT *, x // 500 % 3 * 50 AS off, greatest(0, x - 125) AS low, least(n_chars, x + 125) AS high FROM b WHERE n_chars - x >= 125),
    e AS (SELECT doc_id, CASE WHEN off > 0 AND off < high - low THEN low + off ELSE x END AS z, off > 0 AND off < high - low AS snapped FROM o UNION ALL SELECT doc_id, n_chars, true FROM documents WHERE n_chars > 0)
    SELECT doc_id AS id, coalesce(lag(z) OVER w, 0) AS start_sample, z AS end_sample, snapped FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY z)"""
)
def snapped_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries moved into pauses found around them."""
    media = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("num_samples"))
    gaps = jobs.boundaries(media, 5.0, 100).select("id", "boundary", (F.floor(F.col("boundary") / 500) % 3 * 50).alias("offset"))
    return jobs.plan_chunks(media, 5.0, 100, gaps, jobs.snap_window(5.0)).select("id", "start_sample", "end_sample", "snapped")


@query(
    """WITH f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, floor(value) AS rms FROM events), g AS (SELECT *, min(rms) OVER p AS low, max(k) OVER p / 2 AS centre FROM f WINDOW p AS (PARTITION BY user_id))
    SELECT user_id, arg_min(k, abs(k - centre) * 1000000 + k) AS k FROM g WHERE rms <= low + 1e-9 GROUP BY user_id"""
)
def quietest_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    frames = table(spark, sf_dir, "events").select("user_id", (F.row_number().over(w) - 1).cast("long").alias("k"), F.floor("value").alias("rms"))
    return jobs.quietest_frame(frames, ["user_id"])


# --- evaluation ------------------------------------------------------------------------------------------------


@query(
    """WITH r AS (SELECT user_id, round(avg(value) / 100, 4) AS c, round(max(value) / 300, 4) AS b FROM events GROUP BY user_id)
    SELECT user_id, 'WER ' || format('{:.4f}', c) || ' against ' || format('{:.4f}', b) || chr(10) || CASE WHEN c < round(b * 0.9, 6) THEN '[PASS] ' ELSE '[FAIL] ' END || 'beats_baseline' || chr(10) || '[SKIP] longform' || chr(10) || 'Gate: ' || CASE WHEN c < round(b * 0.9, 6) THEN 'PASSED' ELSE 'FAILED' END AS text,
        CASE WHEN c < round(b * 0.9, 6) THEN 'PASS' ELSE 'FAIL' END || ' beats_baseline of ' || user_id AS line FROM r"""
)
def gate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "events").groupBy("user_id").agg(T.rounded(F.avg("value") / 100, 4).alias("candidate"), T.rounded(F.max("value") / 300, 4).alias("baseline"))
    beats = metrics.beats_baseline(F.col("candidate"), F.col("baseline"), F.lit(0.1))
    long = metrics.longform_check(F.lit(False), F.lit(False), F.lit(False))
    rows = r.select("user_id", "candidate", "baseline", F.array(F.struct(F.lit("beats_baseline").alias("name"), beats.alias("passed")), F.struct(F.lit("longform").alias("name"), long.alias("passed"))).alias("checks"), metrics.verdict(beats, long).alias("passed"))
    line = metrics.check_line("beats_baseline", F.col("checks")[0]["passed"], F.concat(F.lit("of "), "user_id"))
    return evaluation.rendered(rows).select("user_id", "text", line.alias("line"))


@query(
    """WITH r AS (SELECT round(count(*) FILTER (n_chars % 10 = 0)::DOUBLE / count(*), 6) AS c, round(count(*) FILTER (n_chars % 10 < 2)::DOUBLE / count(*), 6) AS b FROM documents)
    SELECT c AS candidate, b AS baseline, CASE WHEN b <> 0 THEN round((b - c) / b, 6) END AS better, coalesce(c < round(b * 0.9, 6), false) AS passed, 2 AS checks FROM r"""
)
def gate_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate of two models' rates: the share of documents that each gets wrong."""
    d = table(spark, sf_dir, "documents")
    rate = lambda wrong: d.agg(T.rate(F.count_if(wrong), F.count(F.lit(1))).alias("wer"))
    scores = evaluation.tagged(rate(F.col("n_chars") % 10 == 0), rate(F.col("n_chars") % 10 < 2))
    g = evaluation.gate(scores, 0.1, d.agg(F.filter(F.array(F.when(F.count_if(F.col("n_chars") < 0) > 0, "order_violations")), lambda r: r.isNotNull()).alias("regressions")))
    return g.select("candidate", "baseline", F.col("relative_wer_improvement").alias("better"), "passed", F.size("checks").alias("checks"))


@query("SELECT conv_id, turn, length(text) AS n, upper(role) AS hypothesis FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL")
def transcribed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seam to a model, opened once a task: here it spells the samples, which are the role's characters."""
    def open_model():  # noqa: E306
        return lambda x, prompt: "".join(chr(int(c)) for c in x).upper()

    c = table(spark, sf_dir, "conversations").where("text is not null and role is not null")
    rows = c.select("conv_id", "turn", F.length("text").cast("long").alias("n"), F.expr("transform(filter(split(role, ''), x -> x <> ''), x -> cast(ascii(x) as float))").alias("samples"))
    return evaluation.with_hypotheses(rows, open_model)


@query("SELECT 'candidate' AS model, item_id AS id, length(text) AS n FROM benchmark UNION ALL SELECT 'baseline', doc_id, length(text) FROM documents")
def union_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lambda name, key: table(spark, sf_dir, name).select(F.col(key).alias("id"), F.length("text").cast("long").alias("n"))
    return evaluation.tagged(rows("benchmark", "item_id"), rows("documents", "doc_id"))


# --- live ---------------------------------------------------------------------------------------------------------


@query("WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence FROM events WHERE event_type <> 'view') SELECT user_id AS session, event_id, sequence FROM n")
def numbered_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "event_id", F.col("event_id").alias("start"), F.when(F.col("event_type") == "view", " ").otherwise(F.col("event_type")).alias("text"))
    return live.numbered(e).select("session", "event_id", F.col("sequence").cast("long").alias("sequence"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, event_id * 100 AS received, event_id / 160 + CASE WHEN event_id % 7 = 0 THEN 2 ELSE 0 END AS wall, event_id % 2 = 1 AS ok FROM events),
    r AS (SELECT session, seq, received AS s, wall AS w, false AS moved FROM e WHERE seq = 1
        UNION ALL SELECT e.session, e.seq, CASE WHEN ok AND abs(e.wall - (w + (e.received - s) / 16000)) > 1 THEN e.received ELSE s END, CASE WHEN ok AND abs(e.wall - (w + (e.received - s) / 16000)) > 1 THEN e.wall ELSE w END, ok AND abs(e.wall - (w + (e.received - s) / 16000)) > 1
        FROM r JOIN e ON e.session = r.session AND e.seq = r.seq + 1)
    SELECT session, seq, s AS anchor_sample, w AS anchor_wall, moved FROM r"""
)
def clock_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    w = Window.partitionBy("user_id").orderBy("event_id")
    reads = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.row_number().over(w).alias("seq"), (k * 100).alias("received"), (k / 160 + F.when(k % 7 == 0, 2).otherwise(0)).alias("wall"), (k % 2 == 1).alias("caught_up"))
    return live.anchors(reads, 16_000).select("session", "seq", "anchor_sample", "anchor_wall", F.col("drift").isNotNull().alias("moved"))


@query(f"WITH {SQL_RECORDINGS} SELECT 'checkpoint' AS kind, count(*) AS n FROM recordings UNION ALL SELECT 'lines', count(*) FROM recordings")
def written_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as lines and as a table version, and read again."""
    rows, root = table(spark, sf_dir, "documents").select("doc_id", "text"), landing(spark, "lines")
    sinks.write_lines(rows, f"{root}/lines")
    sinks.write_table_version(rows, f"{root}/table", sinks.current_version(spark, f"{root}/table") + 1)
    again = spark.read.parquet(f"{root}/table/v{sinks.current_version(spark, f'{root}/table'):08d}")
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return count(again, "checkpoint").unionByName(count(spark.read.schema("doc_id long, text string").json(f"{root}/lines"), "lines"))
