"""The registered queries: each operator family on the driver's tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import speakers, timing
from vellum.functions import text as T
from vellum.operators import captions, jobs, ledger, lineage, metrics, splits
from vellum.sources import listings
from vellum.streaming import delay, live

from .bindings import CORPUS, NOW, RATIOS, SQL_RECORDINGS, SQL_SYNC, events, recordings, rejections, stored, table, turns
from .bindings import ledger as ledger_rows
from .bindings import listing as listing_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# --- splits and builds -------------------------------------------------------------------

_BUCKET = f"('0x' || substr(sha256('{speakers.split_salt(42)}:' || {{0}}), 1, 8))::BIGINT % 10000"
_SPLIT = f"CASE WHEN {{0}} IS NULL OR {{0}} = '' THEN 'train' WHEN {_BUCKET} < 2000 THEN 'dev' WHEN {_BUCKET} < 4000 THEN 'test' ELSE 'train' END"
_SPLIT_SQL = f"WITH {SQL_RECORDINGS}, split AS (SELECT *, {_SPLIT.format('speaker_id')} AS split FROM recordings)"
_GUARD_SQL = _SPLIT_SQL + ", seen AS (SELECT DISTINCT text_hash FROM split WHERE split <> 'train'), kept AS (SELECT * FROM split WHERE split <> 'train' OR text_hash NOT IN (SELECT text_hash FROM seen))"


@query(f"SELECT c_custkey, {_BUCKET.format('c_custkey::VARCHAR')} AS bucket, {_SPLIT.format('c_custkey::VARCHAR')} AS split FROM customer")
def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(key, speakers.speaker_bucket(key, speakers.split_salt(42)).alias("bucket"), speakers.speaker_split(key, RATIOS).alias("split"))


@query(f"WITH s AS (SELECT {_SPLIT.format('c_custkey::VARCHAR')} AS split FROM customer) SELECT count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'dev') AS dev, count(*) FILTER (split = 'test') AS test FROM s")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_sizes(splits.with_split(table(spark, sf_dir, "customer"), RATIOS, speaker="c_custkey"))


@query(
    _GUARD_SQL
    + """, b AS (SELECT count(*) AS n, count(DISTINCT nullif(speaker_id, '')) AS s FROM split WHERE split = 'train'),
    a AS (SELECT count(*) AS n, count(DISTINCT nullif(speaker_id, '')) AS s, count(DISTINCT text_hash) AS t FROM kept WHERE split = 'train')
    SELECT b.n AS train_rows_before, b.n - a.n AS train_dropped, coalesce((b.n - a.n)::DOUBLE / nullif(b.n, 0), 0) AS dropped_fraction, a.t AS train_distinct_transcripts, b.s - a.s AS train_speakers_lost FROM a, b"""
)
def leakage_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.leakage_stats(stored(splits.with_split(recordings(spark, sf_dir), RATIOS).select("split", "speaker_id", "text_hash"), "splits"))


@query(_GUARD_SQL + " SELECT recording_id, speaker_id, split, text_hash AS audio_sha256, text_hash, duration FROM kept")
def build_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.manifest(splits.guarded(splits.with_split(recordings(spark, sf_dir), RATIOS)))


@query(_GUARD_SQL + " SELECT count(DISTINCT speaker_id) FILTER (split = 'train') AS train_speakers, count(DISTINCT speaker_id) FILTER (split = 'dev') AS dev_speakers, count(DISTINCT speaker_id) FILTER (split = 'test') AS test_speakers FROM kept")
def split_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.speakers_per_split(splits.guarded(splits.with_split(recordings(spark, sf_dir), RATIOS)))


@query(_SPLIT_SQL + " SELECT coalesce(bool_and(n = 1), true) AS speaker_disjoint FROM (SELECT count(DISTINCT split) AS n FROM split WHERE speaker_id IS NOT NULL GROUP BY speaker_id)")
def split_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.speaker_disjoint(splits.with_split(recordings(spark, sf_dir), RATIOS))


# --- scalar functions -----------------------------------------------------------------------


@query(f"WITH {SQL_RECORDINGS} SELECT recording_id, length(text) AS n_text, text_hash FROM recordings")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recordings(spark, sf_dir).select("recording_id", F.length("text").cast("long").alias("n_text"), "text_hash")


_PAD = {n: "".join(f"{b ^ n:02x}" for b in b"salt".ljust(64, b"\0")) for n in (0x36, 0x5C)}


@query(
    f"""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 5 <> 0 THEN c_custkey::VARCHAR END AS v FROM customer)
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN v WHEN v IS NOT NULL THEN left(sha256(unhex('{_PAD[0x5C]}') || unhex(sha256(unhex('{_PAD[0x36]}') || encode(v)))), 24) END AS speaker_id, CASE WHEN v IS NULL THEN 'speaker_id_email_dropped' END AS dropped FROM c"""
)
def speaker_pseudonym(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('"'), F.col("c_name"), F.lit('"'))).when(F.col("c_custkey") % 5 == 0, F.lit('"a@b.c"')).otherwise(F.col("c_custkey").cast("string")).alias("j"))
    kept, reason = speakers.resolve_speaker(F.parse_json("j"), "salt")
    return ids.select("c_custkey", kept.alias("speaker_id"), reason.alias("dropped"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, format('{:02d}:{:02d}:{:02d}.{:03d}', s // 3600000, s // 60000 % 60, s // 1000 % 60, s % 1000) AS stamp FROM (SELECT event_id, ts, round_even(value * 1000, 0)::BIGINT AS s FROM events)")
def timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", timing.utc_iso(F.col("ts")).alias("iso"), timing.format_timestamp(F.col("value")).alias("stamp"))


@query(r"SELECT page_id, coalesce(regexp_matches(lower(url), '^https?://([^/@?#]*\.)?example\.(com|org)([/:?#]|$)'), false) AS allowed FROM pages")
def url_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.host_allowed(F.col("url"), ["*.example.com", "*.example.org", "example.com", "example.org"]).alias("allowed"))


@query("SELECT page_id, substr(regexp_replace(trim(regexp_replace(replace(url, 'example', '***'), '\\s+', ' ', 'g')), '$', ''), 1, 300) AS scrubbed FROM pages")
def secret_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.scrubbed(F.col("url"), ["example"]).alias("scrubbed"))


@query("SELECT event_id, event_type AS named FROM events")
def recursive_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = F.to_json(F.struct("props", F.array(F.struct(F.col("event_type").alias("k"))).alias("inner")))
    rows = table(spark, sf_dir, "events").select("event_id", nested.alias("content"))
    return lineage.versions_named(rows, key="k").select("event_id", F.col("k").alias("named"))


# --- ledger ------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE coalesce(n_chars / 100, 0) BETWEEN 0.5 AND 30")
def duration_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(ledger.within_gate(F.col("n_chars") / 100)).select("doc_id")


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.classify(ledger_rows(spark, sf_dir), listing_rows(spark, sf_dir), rejections(spark, sf_dir).select("recording_id", "audio_path"), CORPUS)


@query(f"WITH {SQL_SYNC} SELECT recording_id, action, reason FROM classified")
def sync_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("recording_id", "action", "reason")


@query(f"WITH {SQL_SYNC} SELECT count(*) FILTER (action = 'added') AS added, count(*) FILTER (action = 'updated') AS updated, count(*) FILTER (action = 'removed') AS removed, count(*) FILTER (action = 'unchanged') AS unchanged FROM classified")
def sync_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.summary(_classified(spark, sf_dir))


@query(f"WITH {SQL_SYNC} SELECT reason, count(*) AS n FROM (SELECT reason FROM classified UNION ALL SELECT speaker_reason FROM classified) WHERE reason IS NOT NULL GROUP BY reason")
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.skip_counts(_classified(spark, sf_dir))


@query(f"WITH {SQL_SYNC} SELECT count(*) AS active, count(*) FILTER (l.recording_id IS NULL) AS gone, count(*) FILTER (l.recording_id IS NULL) > 5 AND count(*) FILTER (l.recording_id IS NULL) > 0.5 * count(*) AS refused FROM ledger o LEFT JOIN listing l USING (recording_id) WHERE o.status = 'active'")
def mass_removal_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.mass_removal(ledger_rows(spark, sf_dir), listing_rows(spark, sf_dir))


@query(
    f"""WITH {SQL_SYNC}, c AS (SELECT * FROM classified WHERE action IN ('added', 'updated')),
    gone AS (SELECT recording_id FROM ledger WHERE status = 'active' AND recording_id NOT IN (SELECT recording_id FROM listing))
    SELECT coalesce(o.recording_id, c.recording_id) AS recording_id, CASE WHEN c.recording_id IS NOT NULL THEN 'active' WHEN g.recording_id IS NOT NULL THEN 'removed' ELSE o.status END AS status,
        CASE WHEN c.recording_id IS NOT NULL THEN c.audio_path WHEN g.recording_id IS NOT NULL THEN NULL ELSE o.audio_path END AS audio_path,
        CASE WHEN c.recording_id IS NOT NULL THEN CASE WHEN c.current THEN o.duration ELSE c.duration END WHEN g.recording_id IS NOT NULL THEN NULL ELSE o.duration END AS duration,
        CASE WHEN c.recording_id IS NOT NULL OR (o.status = 'active' AND g.recording_id IS NULL) THEN '{NOW}' ELSE '2024-01-01T00:00:00Z' END AS last_seen,
        CASE WHEN o.recording_id IS NULL THEN '{NOW}' ELSE '2024-01-01T00:00:00Z' END AS first_seen
    FROM ledger o FULL JOIN c ON c.recording_id = o.recording_id LEFT JOIN gone g ON g.recording_id = o.recording_id"""
)
def ledger_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    after, _, _ = ledger.sync(ledger_rows(spark, sf_dir), rejections(spark, sf_dir), listing_rows(spark, sf_dir), CORPUS, NOW)
    return after.select("recording_id", "status", "audio_path", "duration", "last_seen", "first_seen")


@query(
    f"""WITH {SQL_SYNC}, stale AS (SELECT recording_id FROM rejections WHERE recording_id NOT IN (SELECT recording_id FROM listing)),
    kept AS (SELECT recording_id, 'audio_undecodable' AS reason, audio_path FROM rejections WHERE recording_id NOT IN (SELECT recording_id FROM stale) AND recording_id NOT IN (SELECT recording_id FROM classified WHERE action IN ('added', 'updated'))),
    bad AS (SELECT recording_id, reason, audio_path FROM classified WHERE reason IN ('audio_undecodable', 'duration_out_of_range'))
    SELECT * FROM bad UNION ALL SELECT * FROM kept WHERE recording_id NOT IN (SELECT recording_id FROM bad)"""
)
def rejected_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejected, _ = ledger.sync(ledger_rows(spark, sf_dir), rejections(spark, sf_dir), listing_rows(spark, sf_dir), CORPUS, NOW)
    return rejected.select("recording_id", "reason", "audio_path")


@query(f"WITH {SQL_SYNC} SELECT count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'removed') AS removed FROM ledger")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.status_counts(ledger_rows(spark, sf_dir))


@query(f"WITH {SQL_SYNC} SELECT DISTINCT text_hash AS audio_sha256 FROM ledger o WHERE status = 'active' AND audio_path = 'src3' AND NOT EXISTS (SELECT 1 FROM ledger x WHERE x.status = 'active' AND x.audio_path <> 'src3' AND x.text_hash = o.text_hash)")
def erasable_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(ledger_rows(spark, sf_dir).select("recording_id", "status", "audio_path", "audio_sha256"), "ledger")
    return ledger.erasable_hashes(rows, rows.where("status = 'active' and audio_path = 'src3'").select("recording_id"))


@query(
    """SELECT (count(*) FILTER (o.recording_id IS NULL OR NOT (o.t IS NULL OR o.t IS NOT DISTINCT FROM e.t)) = 0) AND count(*) = (SELECT count(*) FROM documents) AS paired, count(*) AS n, (SELECT count(*) FROM documents) AS files
    FROM (SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g')) AS t FROM documents) e
    LEFT JOIN (SELECT doc_id AS recording_id, CASE WHEN doc_id % 2 = 0 THEN trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g')) END AS t FROM documents) o ON o.recording_id = e.doc_id"""
)
def pairing_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    name = F.format_string("%08d.wav", "doc_id")
    export = d.select(name.alias("file"), "text")
    manifest = d.select(F.col("doc_id").alias("id"), name.alias("export_name"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("text"))
    return listings.paired(export, manifest).select("paired", "n", "files")


# --- lineage -------------------------------------------------------------------------------------


def _manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("speaker_id"), F.col("o_orderpriority").alias("dataset_version"), F.col("o_orderstatus").alias("split"))


_MANIFESTS = "m AS (SELECT 'c' || o_custkey::VARCHAR AS speaker_id, o_orderpriority AS dataset_version, o_orderstatus AS split FROM orders)"
_MODELS = "(VALUES ('m1', '1-URGENT'), ('m2', '2-HIGH'), ('m3', '1-URGENT')) AS models(path, dataset_version)"


def _models(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {_MODELS}")


@query(f"WITH {_MANIFESTS} SELECT speaker_id, dataset_version, count(*) AS recordings, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM m GROUP BY speaker_id, dataset_version")
def speaker_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.speaker_datasets(_manifests(spark, sf_dir))


@query(f"WITH {_MANIFESTS} SELECT DISTINCT speaker_id, path, dataset_version FROM m JOIN {_MODELS} USING (dataset_version)")
def speaker_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.speaker_models(_manifests(spark, sf_dir), _models(spark))


@query(
    """WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
    SELECT o_custkey, o_orderkey AS version FROM r WHERE n > 3 AND o_orderstatus <> 'P'"""
)
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("created_at"), "o_orderstatus")
    models = o.where("o_orderstatus = 'P'").select(F.col("version").alias("dataset_version"))
    return lineage.retention(o, models, 3, by=["o_custkey"]).select("o_custkey", "version")


@query(
    f"""WITH {SQL_SYNC}, ids AS (SELECT recording_id, text_hash FROM ledger WHERE status = 'active' AND speaker_id = 'spk5'),
    own AS (SELECT DISTINCT text_hash FROM ids), used AS (SELECT DISTINCT text_hash FROM ledger WHERE status = 'active' AND recording_id NOT IN (SELECT recording_id FROM ids))
    SELECT 'tombstone' AS kind, recording_id::VARCHAR AS target FROM ids
    UNION ALL SELECT 'erase_audio', text_hash FROM own WHERE text_hash NOT IN (SELECT text_hash FROM used)
    UNION ALL SELECT 'shared_audio', text_hash FROM own WHERE text_hash IN (SELECT text_hash FROM used)
    UNION ALL SELECT 'supersede', v FROM (SELECT DISTINCT 'v' || (recording_id % 3)::VARCHAR AS v FROM recordings WHERE speaker_id = 'spk5')
    UNION ALL SELECT 'review_model', path FROM (VALUES ('m1', 'v0'), ('m2', 'v1'), ('m3', 'old')) AS x(path, v) WHERE v = 'old' OR v IN (SELECT 'v' || (recording_id % 3)::VARCHAR FROM recordings WHERE speaker_id = 'spk5')"""
)
def purge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifests = recordings(spark, sf_dir).select("speaker_id", F.concat(F.lit("v"), (F.col("recording_id") % 3).cast("string")).alias("dataset_version"), F.lit("train").alias("split"))
    models = spark.sql("SELECT * FROM VALUES ('m1', 'v0'), ('m2', 'v1'), ('m3', 'old') AS x(path, dataset_version)")
    rows = stored(ledger_rows(spark, sf_dir).select("recording_id", "status", "speaker_id", "audio_sha256"), "ledger")
    return lineage.purge_plan(rows, manifests, spark.sql("SELECT 'old' AS dataset_version"), models, "spk5")


# --- metrics -----------------------------------------------------------------------------------------

_TURNS = r"""t AS (SELECT conv_id, turn, role, text AS reference, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS hypothesis FROM conversations),
n AS (SELECT *, trim(regexp_replace(regexp_replace(lower(nfc_normalize(coalesce(reference, ''))), '[\p{P}\p{S}]', ' ', 'g'), '\s+', ' ', 'g')) AS a, trim(regexp_replace(regexp_replace(lower(nfc_normalize(coalesce(hypothesis, ''))), '[\p{P}\p{S}]', ' ', 'g'), '\s+', ' ', 'g')) AS b FROM t)"""


#: DuckDB's edit distance counts bytes, so letters of two bytes become capitals, which the texts no longer have.
_ONE_BYTE = "translate({}, 'äöüßéèêëàâçîïôùûñáíóú', 'ABCDEFGHIJKLMNOPQRSTU')"


@query(f"WITH {_TURNS} SELECT role AS speaker_id, count(*) AS n, round(sum(levenshtein({_ONE_BYTE.format('a')}, {_ONE_BYTE.format('b')}))::DOUBLE / nullif(sum(length(a)), 0), 6) AS cer FROM n GROUP BY role")
def cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.metrics(turns(spark, sf_dir), ["speaker_id"]).select("speaker_id", "n", "cer")


_BYTES = "translate({}, 'äöüßéèêëàâçîïôùûñáíóúÄÖÜÉÈÊÇÑÍÓÀ', '!#$%&()*+-/:;<=>?@[]^_`{{|}}~0123456789')"

#: Word distances (w) and letter distances of the texts as compared (kind n) and as they are (kind r): a row of the table of distances for each word of the hypothesis, all pairs at once.
_EDITS = rf"""{_TURNS},
x AS (SELECT *, trim(regexp_replace(coalesce(reference, ''), '\s+', ' ', 'g')) AS ra, trim(regexp_replace(coalesce(hypothesis, ''), '\s+', ' ', 'g')) AS rb FROM n),
w AS (SELECT row_number() OVER () AS p, *, list_filter(string_split(s, ' '), lambda v: v <> '') AS wa, list_filter(string_split(u, ' '), lambda v: v <> '') AS wb
    FROM (SELECT 'n' AS kind, conv_id, role, reference, a AS s, b AS u FROM x UNION ALL SELECT 'r', conv_id, role, reference, ra, rb FROM x)),
r(p, j, cells) AS (SELECT p, 0::BIGINT, range(0, len(wa) + 1) FROM w
    UNION ALL SELECT p, j + 1, list(v ORDER BY i) FROM (SELECT p, j, i, i + min(t - i) OVER (PARTITION BY p ORDER BY i) AS v FROM (
        SELECT p, j, i, CASE WHEN i = 0 THEN j + 1 ELSE least(cells[i + 1] + 1, cells[i] + CASE WHEN wa[i] = wb[j + 1] THEN 0 ELSE 1 END) END AS t
        FROM (SELECT r.p, r.j, r.cells, w.wa, w.wb, unnest(range(0, len(r.cells))) AS i FROM r JOIN w ON w.p = r.p AND r.j < len(w.wb)))) GROUP BY p, j),
d AS (SELECT kind, conv_id, role, reference, len(wa) AS words, cells[len(wa) + 1] AS edits, length(s) AS letters, levenshtein({_BYTES.format('s')}, {_BYTES.format('u')}) AS letter_edits FROM w JOIN r ON r.p = w.p AND r.j = len(wb))"""
_RATE = "round(sum({0}) FILTER (kind = '{2}')::DOUBLE / nullif(sum({1}) FILTER (kind = '{2}'), 0), 6)"


@query(
    f"WITH RECURSIVE {_EDITS} SELECT role AS speaker_id, count(*) FILTER (kind = 'n') AS n, coalesce(sum(words) FILTER (kind = 'n'), 0)::BIGINT AS reference_words, {_RATE.format('edits', 'words', 'n')} AS wer, "
    f"{_RATE.format('letter_edits', 'letters', 'n')} AS cer, {_RATE.format('edits', 'words', 'r')} AS wer_raw, {_RATE.format('letter_edits', 'letters', 'r')} AS cer_raw FROM d GROUP BY role"
)
def wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.metrics(turns(spark, sf_dir), ["speaker_id"])


@query(
    f"WITH RECURSIVE {_EDITS} SELECT concat_ws('-', role, conv_id % 20) AS speaker_id, {_RATE.format('edits', 'words', 'n')} AS wer, count(*) AS utterances, sum(words)::BIGINT AS reference_words, round(coalesce(sum(length(reference) / 10), 0), 3) AS audio_seconds, "
    "coalesce(sum(length(reference) / 10), 0) < 30 AS low_audio FROM d WHERE kind = 'n' GROUP BY 1"
)
def per_speaker_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).withColumn("speaker_id", F.concat_ws("-", "speaker_id", (F.col("conv_id") % 20).cast("string")))
    return metrics.per_speaker(rows)


@query("SELECT user_id, count(value) AS n, min(value) AS min, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.9) AS p90, max(value) AS max FROM events WHERE value IS NOT NULL GROUP BY user_id")
def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.spread(table(spark, sf_dir, "events"), "value", ["user_id"])


_SEGMENTS = "s AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 - 1704067200 AS start, epoch_us(ts) / 1e6 - 1704067200 + value AS \"end\" FROM events)"
_SANITY = f"""WITH {_SEGMENTS}, l AS (SELECT *, lag("end", 1, 0.0) OVER (PARTITION BY user_id ORDER BY start, event_id) AS p FROM s),
    g AS (SELECT user_id, count(*) AS n, count(*) FILTER ("end" < start OR start < p - 0.05) AS bad, count(*) FILTER ("end" - start >= 25) AS longs, arg_max("end", (start, event_id)) AS z, max("end") AS d FROM l GROUP BY user_id)"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("user_id", "event_id", (F.col("at") - 1704067200).alias("start"), (F.col("at") - 1704067200 + F.col("value")).alias("end"))


@query(_SANITY + " SELECT user_id, n AS n_segments, bad AS order_violations, round(longs / n, 4) AS long_segment_fraction, round(z / d, 3) AS coverage FROM g")
def timestamp_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.timestamp_sanity(_segments(spark, sf_dir), ["user_id"], ["start", "event_id"], F.max("end"))
    return rows.select("user_id", "n_segments", "order_violations", T.rounded("long_segment_fraction", 4).alias("long_segment_fraction"), T.rounded("coverage", 3).alias("coverage"))


@query(
    _SANITY
    + """, f AS (SELECT user_id, bad, round(longs / n, 6) AS l, round(z / d, 4) AS c, round(bad / n, 6) AS w FROM g), x AS (SELECT a.user_id, round(a.w - b.w, 6) > 0.02 AS worse, a.bad > b.bad AS more, a.l > 2 * b.l AND a.l - b.l >= 0.05 AS longer, b.c - a.c > 0.1 AS short FROM f a JOIN f b ON b.user_id = a.user_id + 1)
    SELECT user_id, concat_ws(',', CASE WHEN worse THEN 'wer' END, CASE WHEN more THEN 'order_violations' END, CASE WHEN longer THEN 'long_segments' END, CASE WHEN short THEN 'coverage' END) AS reasons FROM x"""
)
def longform_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.timestamp_sanity(_segments(spark, sf_dir), ["user_id"], ["start", "event_id"], F.max("end"))
    pack = F.struct(T.rounded(F.col("order_violations") / F.col("n_segments"), 6).alias("wer"), "order_violations", "long_segment_fraction", "coverage")
    a, b = rows.select("user_id", pack.alias("candidate")), rows.select((F.col("user_id") - 1).alias("user_id"), pack.alias("baseline"))
    return a.join(b, "user_id").select("user_id", F.array_join(metrics.regressions(), ",").alias("reasons"))


@query(
    """WITH r AS (SELECT user_id, avg(value) / 100 AS c, max(value) / 300 AS b FROM events GROUP BY user_id)
    SELECT user_id, coalesce(c < round(b * 0.9, 6), false) AS beats, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id % 3 = 1 END AS longform, coalesce(c < round(b * 0.9, 6), false) AND (user_id % 3 = 0 OR user_id % 3 = 1) AS passed FROM r"""
)
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "events").groupBy("user_id").agg((F.avg("value") / 100).alias("c"), (F.max("value") / 300).alias("b"))
    kind = F.col("user_id") % 3
    beats, longform = metrics.beats_baseline(F.col("c"), F.col("b"), F.lit(0.1)), metrics.longform_check(kind == 2, kind != 0, F.lit(False))
    return r.select("user_id", beats.alias("beats"), longform.alias("longform"), metrics.verdict(beats, longform).alias("passed"))


# --- jobs ------------------------------------------------------------------------------------------------


@query(
    """WITH b AS (SELECT doc_id, n_chars, unnest(generate_series(500, n_chars - 1, 500)) AS x FROM documents),
    e AS (SELECT doc_id, x AS z, false AS snapped FROM b WHERE n_chars - x >= 125 UNION ALL SELECT doc_id, n_chars, true FROM documents WHERE n_chars > 0)
    SELECT doc_id AS id, (row_number() OVER w - 1)::INTEGER AS index, coalesce(lag(z) OVER w, 0) AS start_sample, z AS end_sample, coalesce(lag(z) OVER w, 0) / 100 AS start, z / 100 AS "end", snapped FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY z)"""
)
def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("num_samples"))
    return jobs.plan_chunks(media, 5.0, 100)


_GAPS = """g AS (SELECT user_id, coalesce(lag(z) OVER w, 0) AS a, t AS b FROM (SELECT user_id, event_id, epoch_us(ts) // 1000000 - 1704067200 AS t, epoch_us(ts) // 1000000 - 1704067200 AS z FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))"""


@query(
    f"""WITH {_GAPS}, u AS (SELECT *, b - a AS size, (a + b) // 2 AS cut, row_number() OVER (PARTITION BY user_id ORDER BY b - a DESC, abs((a + b) // 2 - 1296000), a) AS n FROM g WHERE b - a >= 600)
    SELECT user_id, cut, size AS gap FROM u WHERE n = 1"""
)
def longest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000) - 1704067200
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    gaps = table(spark, sf_dir, "events").withColumn("t", t).select("user_id", F.lag("t", 1, 0).over(w).alias("gap_start"), F.col("t").alias("gap_end"))
    return jobs.longest_gap(gaps, ["user_id"], F.lit(1296000), 600)


@query(
    """WITH p AS (SELECT conv_id AS job, turn AS i, trim(text) AS text, role, CASE WHEN turn % 2 = 0 THEN role END AS lang, turn % 5 <> 4 AS there FROM conversations)
    SELECT job, coalesce(string_agg(text, ' ' ORDER BY i) FILTER (there AND text <> ''), '') AS text, arg_min(lang, i) FILTER (there AND lang IS NOT NULL) AS language, count(*) FILTER (there) AS chunks_done, count(*) AS chunks_total, bool_and(there) AS complete FROM p GROUP BY job"""
)
def assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("job"), F.col("turn").alias("index"), "text", "role")
    results = c.select("job", "index", F.when(F.col("index") % 5 != 4, F.col("text")).alias("text"), F.when(F.col("index") % 2 == 0, F.col("role")).alias("language"), F.col("role").alias("model"))
    return jobs.assemble(c.select("job", "index"), results).drop("models")


@query("SELECT conv_id AS job, min(turn) AS resume_at FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def resume_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("job"), F.col("turn").alias("index"), "role")
    return jobs.resume_points(c.select("job", "index").distinct(), c.where("role <> 'assistant'"))


@query(
    """WITH o AS (SELECT * REPLACE (floor(o_totalprice) AS o_totalprice) FROM orders), r AS (SELECT o_custkey, sum(o_totalprice) AS s FROM o WHERE o_orderstatus = 'P' GROUP BY o_custkey),
    q AS (SELECT o.*, o_orderkey % 13 = 0 AS u FROM o WHERE o_orderstatus = 'O'),
    w AS (SELECT q.o_custkey, o_orderkey, u, o_totalprice, row_number() OVER x AS position, coalesce(r.s, 0) + coalesce(sum(CASE WHEN u THEN 0 ELSE o_totalprice END) OVER y, 0) AS ahead, coalesce(sum(u::INT) OVER y, 0) AS unknown
        FROM q LEFT JOIN r USING (o_custkey) WINDOW x AS (PARTITION BY q.o_custkey ORDER BY o_orderdate, o_orderkey), y AS (PARTITION BY q.o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT o_custkey, o_orderkey AS id, position, unknown::BIGINT AS unknown_ahead, CASE WHEN unknown = 0 THEN ahead / 2 END AS estimated_start_seconds, CASE WHEN unknown = 0 AND NOT u THEN (ahead + o_totalprice) / 2 END AS estimated_finish_seconds, ahead AS seconds_ahead FROM w"""
)
def queue_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rows = o.select("o_custkey", F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("completed").alias("status"), F.col("o_orderdate").alias("created_at"),
        F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 13 == 0), None).otherwise(F.floor("o_totalprice").cast("double")).alias("duration"), F.lit(0.0).alias("current"))
    q = jobs.queue_overview(rows, 2.0, ["o_custkey"])
    return q.select("o_custkey", "id", "position", F.col("unknown_ahead").cast("long").alias("unknown_ahead"), "estimated_start_seconds", "estimated_finish_seconds", "seconds_ahead")


@query(
    """WITH r AS (SELECT l_suppkey, l_quantity / l_extendedprice AS x, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS n FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0)
    SELECT l_suppkey, median(x) AS rate, count(*) AS samples FROM r WHERE n <= 5 GROUP BY l_suppkey"""
)
def job_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", F.col("l_quantity").alias("audio_seconds"), F.col("l_extendedprice").alias("wall_seconds"))
    return jobs.median_rate(jobs.last_samples(rows, ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"]), ["l_suppkey"])


@query(
    """WITH j AS (SELECT user_id, list_sort(list(round(value, 2))) AS ends, count(*) AS n, max(round(value, 2)) AS total FROM events GROUP BY user_id),
    k AS (SELECT *, n // 2 AS done FROM j)
    SELECT user_id, CASE WHEN done = n THEN 100.0 ELSE least(100.0, coalesce(ends[done], 0) / total * 100) END AS percent, coalesce(ends[done], 0) AS current_seconds, n AS chunks_total,
        CASE WHEN done = n THEN 0.0 WHEN coalesce(ends[done], 0) > 0 THEN greatest(1.0, 100 / ends[done] * (total - ends[done]) - 10) END AS eta_seconds FROM k"""
)
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    j = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(T.rounded("value", 2))).alias("ends"))
    rows = j.select("user_id", "ends", F.floor(F.size("ends") / 2).cast("int").alias("done"), F.array_max("ends").alias("total_seconds"), at.alias("started"), (at + F.expr("interval 100 seconds")).alias("updated"), F.lit(0).alias("baseline"))
    out = jobs.progress(rows, at + F.expr("interval 110 seconds"))
    return out.select("user_id", "percent", "current_seconds", F.col("chunks_total").cast("long").alias("chunks_total"), "eta_seconds")


@query(
    """WITH d AS (SELECT user_id, max(value) AS d FROM events GROUP BY user_id), w AS (SELECT user_id, d, greatest(1, ceil((d - 5) / 25))::INT AS n FROM d WHERE d > 0)
    SELECT e.event_id, least(floor(e.value / 25)::INT, n - 1) AS k FROM events e JOIN w USING (user_id)
    WHERE e.value >= least(floor(e.value / 25), n - 1) * 25 AND e.value < CASE WHEN least(floor(e.value / 25), n - 1) = n - 1 THEN d ELSE (least(floor(e.value / 25), n - 1) + 1) * 25 END"""
)
def overlap_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id", F.col("value").alias("start"))
    media = e.groupBy("id").agg(F.max("start").alias("duration"))
    return jobs.owned_words(e, jobs.overlapping_windows(media, 30.0, 5.0), 25.0).select("event_id", "k")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderdate < TIMESTAMP '1996-01-01' - INTERVAL 72 HOUR")
def ttl_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rows = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "queued").otherwise("completed").alias("status"), F.col("o_orderdate").cast("string").alias("finished_at"), F.lit(None).cast("string").alias("updated_at"))
    return jobs.expired(rows, F.lit("1996-01-01").cast("timestamp"), 72).select("o_orderkey")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN (p_partkey * 16.0 + p_partkey * 2.0 + p_partkey * 4.0 * 4) / 1073741824 + 1 ELSE (p_partkey * 4.0 + p_partkey * 0.32 + p_partkey * 4.0 * 4 * 2 * 0.15) / 1073741824 + 1 END AS gb FROM part")
def memory_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey").cast("double")
    even = F.col("p_partkey") % 2 == 0
    return table(spark, sf_dir, "part").select("p_partkey", jobs.training_memory(p, F.when(even, "full").otherwise("lora"), even, ~even, F.lit(4)).alias("gb"))


@query("SELECT conv_id AS job, turn AS index, CASE WHEN lag(turn) OVER w = turn - 1 THEN lag(text) OVER w END AS previous_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def previous_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("job"), F.col("turn").alias("index"), "text")
    return jobs.previous_texts(c).drop("text")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'sv' ELSE 'fi' END AS language, 'queued' AS status FROM orders")
def job_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = F.when(F.col("o_orderpriority") == "1-URGENT", F.create_map(F.lit("language"), F.lit("sv")))
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), params.alias("params"), F.lit("path").alias("kind"), F.lit("p").alias("path"), F.lit(None).cast("string").alias("url"))
    made = jobs.created(requests, {"language": "fi", "chunk_seconds": "60"}, F.lit(NOW).cast("timestamp"))
    return made.select("id", F.col("params")["language"].alias("language"), "status")


# --- captions --------------------------------------------------------------------------------------------------


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    tokens = F.split(T.collapsed(F.array_join(F.transform("t", lambda x: x["text"]), " ")), " ")
    return c.select("conv_id", F.posexplode(tokens).alias("seq", "text")).select("conv_id", "seq", (F.col("seq") * 0.5).alias("start"), (F.col("seq") * 0.5 + 0.4).alias("end"), "text", F.lit(False).alias("whole"))


_FITS = f"CASE WHEN contains('{timing.CLOSING}', left(w.token, 1)) OR contains('{timing.OPENING}', right(r.text, 1)) THEN r.text || w.token ELSE r.text || ' ' || w.token END"
_STOPS = ", ".join(f"'{x}'" for x in captions.STOPS)

#: Words one after the other: each goes on with the cue before it or begins the next; then lines as wide as they may be.
_WORD_CUES = rf"""s AS (SELECT conv_id, trim(regexp_replace(string_agg(text, ' ' ORDER BY turn, text), '\s+', ' ', 'g')) AS s FROM conversations WHERE text IS NOT NULL GROUP BY conv_id),
w AS (SELECT conv_id, unnest(range(0, len(t))) AS seq, unnest(t) AS token FROM (SELECT conv_id, string_split(s, ' ') AS t FROM s WHERE s <> '')),
r(conv_id, seq, cue, text, first) AS (SELECT conv_id, seq, 0, token, seq FROM w WHERE seq = 0
    UNION ALL SELECT conv_id, seq, CASE WHEN new THEN cue + 1 ELSE cue END, CASE WHEN new THEN token ELSE longer END, CASE WHEN new THEN seq ELSE first END FROM (
        SELECT w.conv_id, w.seq, r.cue, w.token, r.first, {_FITS} AS longer, (w.seq - r.first) * 0.5 + 0.4 > {captions.MAX_SECONDS} OR length(replace({_FITS}, ' ', '')) > {2 * captions.MAX_CHARS} OR right(r.text, 1) IN ({_STOPS}) AS new
        FROM r JOIN w ON w.conv_id = r.conv_id AND w.seq = r.seq + 1)),
g AS (SELECT conv_id, cue, any_value(first) AS first, max(seq) AS last, string_split(arg_max(text, seq), ' ') AS t FROM r GROUP BY conv_id, cue),
l AS (SELECT *, greatest(1, len(list_filter(range(1, len(t) + 1), lambda i: length(array_to_string(t[1:i], ' ')) <= {captions.MAX_CHARS}))) AS n FROM g),
cues AS (SELECT conv_id, first, last, array_to_string(t[1:n], ' ') || CASE WHEN n < len(t) THEN chr(10) || array_to_string(t[n + 1 : len(t)], ' ') ELSE '' END AS text FROM l)"""
_AT = "format('{{:02d}}:{{:02d}}:{{:02d}}.{{:03d}}', ({0}) // 3600000, ({0}) // 60000 % 60, ({0}) // 1000 % 60, ({0}) % 1000)"


@query(f"WITH RECURSIVE {_WORD_CUES} SELECT conv_id, first * 0.5::DOUBLE AS start, last * 0.5::DOUBLE + 0.4::DOUBLE AS \"end\", text FROM cues")
def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions.make_cues(_words(spark, sf_dir), "conv_id")


@query(
    f"WITH RECURSIVE {_WORD_CUES} SELECT conv_id, 'WEBVTT' || repeat(chr(10), 2) || string_agg({_AT.format('first * 500')} || ' --> ' || {_AT.format('last * 500 + 400')} || chr(10) || "
    "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || repeat(chr(10), 2), '' ORDER BY first) AS content FROM cues GROUP BY conv_id"
)
def captions_vtt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions.to_vtt(cues(spark, sf_dir), "conv_id")


_CUES = "c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE text IS NOT NULL)"


def _turn_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with a text as a cue of half a second."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    return c.select("conv_id", F.col("turn").cast("double").alias("start"), (F.col("turn") + 0.5).alias("end"), "text")


@query(f"WITH {_CUES} SELECT conv_id, 'WEBVTT\n\n' || string_agg(format('00:{{:02d}}:{{:02d}}.000 --> 00:{{:02d}}:{{:02d}}.500', turn // 60, turn % 60, turn // 60, turn % 60) || '\n' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '\n\n', '' ORDER BY n) AS content FROM c GROUP BY conv_id")
def turns_vtt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions.to_vtt(_turn_cues(spark, sf_dir), "conv_id")


@query(f"WITH {_CUES} SELECT conv_id, string_agg(n::VARCHAR || '\n' || format('00:{{:02d}}:{{:02d}},000 --> 00:{{:02d}}:{{:02d}},500', turn // 60, turn % 60, turn // 60, turn % 60) || '\n' || text || '\n\n', '' ORDER BY n) AS content FROM c GROUP BY conv_id")
def turns_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions.to_srt(_turn_cues(spark, sf_dir), "conv_id")


@query(rf"WITH {_CUES}, l AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS line FROM c) SELECT conv_id, string_agg(strftime(TIMESTAMP '2024-01-01 23:59:58' + to_seconds(turn), '%Y-%m-%dT%H:%M:%S.%g') || ' region:reg1#cue1' || chr(10) || line, chr(10) ORDER BY n) || chr(10) AS content FROM l WHERE line <> '' GROUP BY conv_id")
def turns_youtube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions.to_youtube(_turn_cues(spark, sf_dir), "conv_id", F.lit("2024-01-01 23:59:58").cast("timestamp"), region="reg1")


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS content FROM documents")
def plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", captions.to_text(F.col("text"), F.array().cast("array<string>")).alias("content"))


# --- live ----------------------------------------------------------------------------------------------------------


@query(
    """WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t FROM events), f AS (SELECT *, coalesce((t - lag(t) OVER w > 3600)::INT, 1) AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
    s AS (SELECT user_id, event_id, t, sum(n) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM f)
    SELECT user_id, session::BIGINT AS session, count(*) AS n FROM s GROUP BY user_id, session"""
)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return live.gap_sessions(e, "user_id", F.col("at"), 3600.0).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, value * 20 - 600 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    r AS (SELECT user_id, event_id, i, CASE WHEN ms > 250 THEN 0.5 ELSE 0.0 END::DOUBLE AS target, CASE WHEN abs(ms) <= 250 THEN 1 ELSE 0 END AS stable FROM e WHERE i = 1
        UNION ALL SELECT e.user_id, e.event_id, e.i,
            CASE WHEN abs(ms) <= 250 THEN CASE WHEN r.stable + 1 >= 20 THEN greatest(0.0, round(r.target - 0.25, 3)) ELSE r.target END
                 WHEN ms > 250 THEN least(120.0, round(r.target + greatest(0.5, least(ms / 1000, r.target + 0.5)), 3)) ELSE r.target END::DOUBLE,
            CASE WHEN abs(ms) <= 250 AND r.stable + 1 < 20 THEN r.stable + 1 ELSE 0 END
        FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
    SELECT user_id::VARCHAR AS session, i AS seq, round(target, 3) AS target, stable FROM r"""
)
def adaptive_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    reports = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"), F.row_number().over(w).cast("long").alias("seq"), (F.col("value") * 20 - 600).alias("mismatch_ms"), F.lit(250.0).alias("tolerance_ms"))
    return delay.delays(reports).select("session", "seq", T.rounded("target", 3).alias("target"), "stable")


@query("SELECT event_id, value > 30 AS dropped FROM events")
def late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", live.late(F.lit(0.0), F.col("value")).alias("dropped"))


@query(
    """WITH n AS (SELECT user_id, event_id, row_number() OVER w AS sequence, epoch_us(ts) / 1e6 + value AS z FROM events WHERE event_type <> 'view' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id AS session, event_id, sequence, round(max(z + 5) OVER (PARTITION BY user_id ORDER BY sequence ROWS UNBOUNDED PRECEDING), 3) AS release_at FROM n"""
)
def delayed_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("session").orderBy("ts", "event_id")
    e = events(spark, sf_dir).where("event_type <> 'view'").withColumnRenamed("user_id", "session").withColumns({"wall_end": F.col("at") + F.col("value")})
    rows = live.released(e.withColumn("sequence", F.row_number().over(w)), 5.0)
    return rows.select("session", "event_id", F.col("sequence").cast("long").alias("sequence"), T.rounded("release_at", 3).alias("release_at"))


@query("WITH b AS (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 20 AS batch FROM events) SELECT user_id AS session, batch, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM b GROUP BY user_id, batch")
def push_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("id"), F.col("event_type").alias("payload"))
    b = live.push_batches(e)
    ids = F.transform("items", lambda x: x["id"])
    return b.select("session", "batch", F.size("items").cast("long").alias("n"), F.array_min(ids).alias("first_id"), F.array_max(ids).alias("last_id"))


@query("WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) SELECT user_id AS session, event_id AS id FROM n WHERE n <= 50 AND event_id > 1000")
def resumed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("id"))
    return live.resumed(e, 1000, history=50)
