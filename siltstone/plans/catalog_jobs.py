"""Registered queries that go through files, a store, indexes and the tools, and their SQL."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import api, cli
from ..functions import arguments, text as texts
from ..functions.analytics import hour_age
from ..operators import indexes, windowing
from ..sources import files, history, transcripts
from . import jobs, search
from .catalog import _SESSIONS, _SM, _TOKENS, _WINDOWS, ORACLES, PRODUCT, WORDS, _lists, _shown, registered
from .providers import CutSummary, Extractive, FallbackAnswer, FixedEmbedder, HashEmbedder, OverlapReranker, TemplatePrefix
from .scratch import scratch
from .tables import note_chunks, query_vector, read, session_chunks, turns

# --- files ---------------------------------------------------------------------------------------------------


def named_files(rows: DataFrame, name: str, order: str, line: str, extension: str) -> str:
    """A new folder with a text file for each name, which may hold folders; lines in order. For made-up sources: each task writes its names' files itself, in the shared folder, which must be mounted as files."""
    spark = rows.sparkSession
    folder = scratch(spark, "files")
    if not folder.startswith(("file:", "/")):
        raise ValueError(f"made-up sources need a shared folder that is mounted as files, not {folder}")
    root, none = "/" + folder.removeprefix("file:").lstrip("/"), "__HIVE_DEFAULT_PARTITION__"

    # Spark's writer of a file for each key asks the file system a dozen things for each, some by a process of its own.
    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out, made, n = None, None, set(), 0
        part = f".{uuid.uuid4().hex}.part"

        def done() -> None:
            if out is not None:
                out.close()
                os.replace(f"{root}/{at}{part}", f"{root}/{at}{extension}")

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != at:
                    done()
                    at, n = key, n + 1
                    parent = os.path.dirname(f"{root}/{at}")
                    if parent not in made:
                        os.makedirs(parent, exist_ok=True)
                        made.add(parent)
                    out = open(f"{root}/{at}{part}", "w", encoding="utf-8", newline="")
                out.write(f"{text or ''}\n")
        done()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    # A number of parts that is given isn't lowered for small rows: a file takes as long as many rows.
    named = rows.select(F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(none)).alias("_name"), order, line).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_name").sortWithinPartitions("_name", order)
    os.makedirs(root, exist_ok=True)
    named.select("_name", line).mapInArrow(written, "n long").agg(F.sum("n")).collect()
    return folder


def transcript_folder(spark: SparkSession, d: str) -> str:
    """Conversations as transcript files, half of them in each of two folders: entries with a time, a working folder and a title; a system turn is a summary."""
    at = F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")
    cwd = F.when(F.col("turn_index") > 0, F.concat(F.lit("/work/"), F.col("turn_index").cast("string"))).alias("cwd")
    said = F.struct(F.col("role").alias("role"), F.col("text").alias("content"))
    line = F.when(F.col("role") == "system", F.to_json(F.struct(F.lit("summary").alias("type"), F.col("text").alias("summary"), at, cwd))).otherwise(F.to_json(F.struct(F.col("role").alias("type"), at, cwd, said.alias("message"))))
    rows = turns(spark, d).select(F.concat(F.lit("p"), F.pmod("session_id", F.lit(2)).cast("string"), F.lit("/"), F.col("session_id").cast("string")).alias("name"), (F.col("turn_index") * 2).alias("at"), line.alias("line"))
    title = turns(spark, d).filter("turn_index % 3 = 1").select(F.concat(F.lit("p"), F.pmod("session_id", F.lit(2)).cast("string"), F.lit("/"), F.col("session_id").cast("string")).alias("name"), (F.col("turn_index") * 2 + 1).alias("at"), F.to_json(F.struct(F.lit("ai-title").alias("type"), F.concat(F.lit("title "), F.col("turn_index").cast("string")).alias("aiTitle"))).alias("line"))
    broken = turns(spark, d).filter("turn_index = 0").select(F.concat(F.lit("p"), F.pmod("session_id", F.lit(2)).cast("string"), F.lit("/"), F.col("session_id").cast("string")).alias("name"), F.lit(1_000_000).alias("at"), F.lit("not json").alias("line"))
    return named_files(rows.unionByName(title).unionByName(broken), "name", "at", "line", ".jsonl")


_FILE_TEXT = "CASE role WHEN 'system' THEN '[Compaction Summary] ' || text ELSE text END"
_FILE_ROLE = "CASE role WHEN 'system' THEN 'compaction' ELSE role END"
_FILE_TURNS = f"""SELECT conv_id::VARCHAR AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_index, {_FILE_ROLE} AS role, sha256({_FILE_TEXT}) AS text_sha256,
    strftime(TIMESTAMP '2024-01-01' + to_hours(conv_id::INT) + to_minutes(turn::INT), '%Y-%m-%dT%H:%M:%SZ') AS occurred_at FROM conversations"""


def _file_turns(lines: DataFrame) -> DataFrame:
    t = transcripts.to_turns(transcripts.parse(lines), PRODUCT)
    return t.select("session_id", F.col("turn_index").cast("long").alias("turn_index"), "role", F.sha2("text", 256).alias("text_sha256"), "occurred_at")


@registered(_FILE_TURNS)
def transcript_tree_scan(spark: SparkSession, d: str) -> DataFrame:
    """Files found in folders of any depth, read line by line, their sessions named by the files."""
    return _file_turns(transcripts.lines(spark, transcript_folder(spark, d)))


@registered(f"{_FILE_TURNS} WHERE conv_id % 2 = 0")
def transcript_flat_scan(spark: SparkSession, d: str) -> DataFrame:
    return _file_turns(transcripts.lines(spark, f"{transcript_folder(spark, d)}/p0", recursive=False))


@registered(f"{_FILE_TURNS} WHERE conv_id IN (SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) ORDER BY (conv_id % 2)::VARCHAR || '/' || conv_id || '.jsonl' LIMIT 7)")
def transcript_file_caps(spark: SparkSession, d: str) -> DataFrame:
    """At most seven files, by path, of at most a gigabyte each."""
    return _file_turns(transcripts.lines(spark, transcript_folder(spark, d), most_bytes=10**9, most_files=7))


@registered("SELECT conv_id::VARCHAR AS session_id, count(*) AS bad FROM conversations WHERE turn = 0 GROUP BY conv_id")
def transcript_bad_lines(spark: SparkSession, d: str) -> DataFrame:
    bad = transcripts.bad_lines(transcripts.parse(transcripts.lines(spark, transcript_folder(spark, d))))
    return bad.groupBy("session_id").agg(F.count(F.lit(1)).alias("bad"))


# --- ingest ----------------------------------------------------------------------------------------------------

_FILE_WINDOWS = _WINDOWS.replace("length(text) AS n", f"length({_FILE_TEXT}) AS n")
_FILE_CHUNKS = f"""WITH {_FILE_WINDOWS}, o AS (SELECT conv_id, turn, {_FILE_TEXT} AS text, {_FILE_ROLE} AS role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
    k AS (SELECT r.conv_id, r.i AS turn_index, max(o.i) AS end_turn_index, r.size AS window_size, CASE WHEN r.size = 1 THEN any_value(o.role) ELSE 'mixed' END AS role, string_agg(o.text, chr(10) || chr(10) ORDER BY o.i) AS body
          FROM r JOIN o ON o.conv_id = r.conv_id AND o.i BETWEEN r.i AND r.i + r.size - 1 GROUP BY r.conv_id, r.i, r.size QUALIFY row_number() OVER (PARTITION BY r.conv_id, body ORDER BY r.i) = 1)"""


def _store(spark: SparkSession, d: str, **options) -> tuple[str, list[dict]]:
    folder = scratch(spark, "store")
    source = files.Source("transcripts", "transcripts", transcript_folder(spark, d), "box")
    return folder, jobs.ingest_sources(spark, files.sources([source], label="transcripts"), folder, "batch", PRODUCT, **options)


@registered(f"""{_FILE_CHUNKS} SELECT conv_id::VARCHAR AS session_id, turn_index, end_turn_index, window_size, role, sha256(body) AS content_hash, false AS is_meta_file, true AS has_cr_prefix, true AS stamped, 'box' AS source_machine FROM k""")
def ingest_store_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that a whole ingest stores: files to turns, windows, secrets out, prefixes, vectors."""
    folder, _ = _store(spark, d, prefixer=TemplatePrefix())
    c = jobs.stored(spark, folder, "session_chunks")
    return c.select(
        "session_id", F.col("turn_index").cast("long").alias("turn_index"), F.col("metadata.end_turn_index").cast("long").alias("end_turn_index"), F.col("metadata.window_size").cast("long").alias("window_size"), "role", "content_hash",
        "is_meta_file", "has_cr_prefix", (F.col("updated_at").isNotNull() & (F.size("embedding") == 64)).alias("stamped"), "source_machine")


@registered("""SELECT conv_id::VARCHAR AS session_id, strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS started_at, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS ended_at, count(*) + count(*) FILTER (turn % 3 = 1) AS message_count,
    CASE WHEN count(*) > 1 THEN '/work/' || min(turn) FILTER (turn > 0) END AS project_path, 'title ' || max(turn) FILTER (turn % 3 = 1) AS summary
    FROM (SELECT *, TIMESTAMP '2024-01-01' + to_hours(conv_id::INT) + to_minutes(turn::INT) AS ts FROM conversations) GROUP BY conv_id""")
def ingest_store_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The facts of each session: times, entries, the first working folder, the last title."""
    folder, _ = _store(spark, d)
    return jobs.stored(spark, folder, "sessions").select("session_id", "started_at", "ended_at", "message_count", "project_path", "summary")


@registered(f"""{_FILE_CHUNKS}, a AS (SELECT (SELECT count(*) FROM r) AS windows_total, count(*) AS windows_new, 0 AS windows_quarantined, count(*) AS windows_inserted, sum(length(body))::BIGINT AS chars_embedded,
    sum(ceil(length(body) / 3.5))::BIGINT AS embed_tokens, 0 AS prefix_input_tokens, 0 AS prefix_cache_read, 0 AS prefix_cache_create, 0 AS prefix_output_tokens FROM k)
    SELECT 1 AS round, 'partial' AS status, * FROM a UNION ALL SELECT 2, 'partial', windows_total, 0, 0, 0, 0, 0, 0, 0, 0, 0 FROM a""")
def ingest_totals(spark: SparkSession, d: str) -> DataFrame:
    """The ten totals of an ingest, and of the same one again, which adds nothing; from the runs' stored last states."""
    folder, first = _store(spark, d)
    source = files.Source("again", "transcripts", transcript_folder(spark, d), "box")
    jobs.ingest_sources(spark, [source], folder, "batch2", PRODUCT)
    states = jobs.runs(jobs.stored(spark, folder, "ingest_runs"))
    return states.select(F.when(F.col("source_label") == "again", 2).otherwise(1).alias("round"), "status", *first[0].keys() & set(jobs.ingest.TOTALS))


@registered(f"""{_FILE_CHUNKS} SELECT 'incremental-local' AS source_label, count(*) AS windows_inserted, 1 AS files_done, 1 AS bad_lines FROM k WHERE conv_id = 3""")
def ingest_single_file(spark: SparkSession, d: str) -> DataFrame:
    root = transcript_folder(spark, d)
    record = jobs.ingest_file(spark, f"{root}/p1/3.jsonl", scratch(spark, "store"), "batch", PRODUCT, local_prefixes=[root])
    names = ["source_label", "windows_inserted", "files_done", "bad_lines"]
    return spark.createDataFrame([tuple(record[k] for k in names)], "source_label string, windows_inserted long, files_done long, bad_lines long")


_NOTES = r"""n AS (SELECT conv_id, regexp_replace(string_agg(CASE WHEN turn = 1 AND conv_id % 9 = 0 THEN 'passwd: s3cr3t-' || conv_id || '-value' ELSE text END, chr(10) || chr(10) ORDER BY turn), '^\s+|\s+$', '', 'g') AS content FROM conversations GROUP BY conv_id)"""


def _notes_store(spark: SparkSession, d: str) -> str:
    """Each conversation as a note, every ninth with a password; ingested."""
    body = F.when((F.col("turn_index") == 1) & (F.col("session_id") % 9 == 0), F.concat(F.lit("passwd: s3cr3t-"), F.col("session_id").cast("string"), F.lit("-value"))).otherwise(F.col("text"))
    rows = turns(spark, d).select(F.when(F.col("session_id") % 5 == 0, F.concat(F.lit("handoff-"), F.col("session_id").cast("string"))).otherwise(F.col("session_id").cast("string")).alias("name"), F.col("turn_index").alias("at"), F.concat(body, F.lit("\n")).alias("line"))
    folder = scratch(spark, "store")
    jobs.ingest_sources(spark, [files.Source("notes", "notes", named_files(rows, "name", "at", "line", ".md"), "box")], folder, "batch", PRODUCT)
    return folder


@registered(rf"""WITH {_NOTES} SELECT CASE WHEN conv_id % 5 = 0 THEN 'handoff-' ELSE '' END || conv_id AS note, CASE WHEN conv_id % 5 = 0 THEN 'handoff' ELSE 'memory' END AS source_type, sha256(content) AS content_hash, 'batch' AS ingest_batch
    FROM n WHERE NOT contains(content, 'passwd: s3cr3t-') AND length(content) BETWEEN 1 AND 8000""")
def ingest_notes_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Notes of up to 8,000 characters are one chunk; those with a secret aren't stored."""
    rows = jobs.stored(spark, _notes_store(spark, d), "note_chunks")
    whole = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("source_path"))).filter("_n = 1")
    return whole.select(F.regexp_extract("source_path", r"([^/]+)\.md$", 1).alias("note"), "source_type", "content_hash", "ingest_batch")


@registered(rf"""WITH {_NOTES} SELECT CASE WHEN conv_id % 5 = 0 THEN 'handoff-' ELSE '' END || conv_id AS note, 'note_chunks' AS source_table, 'password_unquoted' AS reason, 'passwd: ' AS matched_pattern,
    '[quarantined] reason=password_unquoted sha256=' || sha256('corpus/quarantine/fingerprint/v1' || 'passwd: s3cr3t-' || conv_id || '-value') || ' prefix=passwd len=' || length('passwd: s3cr3t-' || conv_id || '-value') AS content
    FROM n WHERE contains(content, 'passwd: s3cr3t-')""")
def ingest_notes_quarantine(spark: SparkSession, d: str) -> DataFrame:
    q = jobs.stored(spark, _notes_store(spark, d), "quarantine")
    return q.select(F.regexp_extract("source_path", r"([^/]+)\.md$", 1).alias("note"), "source_table", "reason", "matched_pattern", "content")


@registered(r"""SELECT session_id, trim(regexp_replace(left(prompt, 600), '\s+', ' ', 'g')) AS summary FROM (SELECT conv_id AS session_id, left(string_agg('[turn ' || turn || '] ' || text, chr(10) || chr(10) ORDER BY turn), 24000) AS prompt FROM conversations GROUP BY conv_id)
    WHERE session_id IN (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 2 = 0 ORDER BY conv_id DESC LIMIT 20)""")
def distil_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of the twenty newest sessions that have none, from their first 2,000 chunks."""
    sessions = turns(spark, d).groupBy("session_id").agg(F.min("occurred_at").alias("started_at"))
    sessions = sessions.withColumn("summary_embedding", F.when(F.col("session_id") % 2 == 1, F.array(F.lit(1.0).cast("float"))))
    return jobs.summaries(sessions, session_chunks(spark, d), CutSummary(), HashEmbedder(), limit=20).select("session_id", "summary")


@registered(r"""SELECT conv_id AS session_id, turn AS turn_index, 'From a conversation that begins: ' || left(trim(regexp_replace(left(d, 480), '\s+', ' ', 'g')), 120) AS prefix, sha256('From a conversation that begins: ' || left(trim(regexp_replace(left(d, 480), '\s+', ' ', 'g')), 120) || chr(10) || chr(10) || text) AS embedded_sha256
    FROM (SELECT *, string_agg(text, chr(10) || chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS d FROM conversations)""")
def context_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Each turn's prefix from its session's text, and what is embedded."""
    t, p = turns(spark, d), TemplatePrefix()
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_index", "text"))), lambda x: x["text"]), "\n\n")
    context = t.groupBy("session_id").agg(p.context(whole).alias("context"))
    made = t.join(context, "session_id").withColumn("prefix", p.prefix(F.col("context"), F.col("text")))
    return made.select("session_id", "turn_index", "prefix", F.sha2(texts.with_prefix(F.col("prefix"), F.col("text")), 256).alias("embedded_sha256"))


# --- indexes and hybrid search of sessions -----------------------------------------------------------------------


@registered(ORACLES["lexical_topk"])
def lexical_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same list from stored postings."""
    return _shown(indexes.lexical_index(note_chunks(spark, d), scratch(spark, "words")).search(WORDS, 20))


@registered(ORACLES["lexical_web_query"])
def lexical_index_web_query(spark: SparkSession, d: str) -> DataFrame:
    return indexes.lexical_index(note_chunks(spark, d), scratch(spark, "words")).hits('"of the" -und or para').select("chunk_id")


def _vectors(spark: SparkSession, d: str) -> indexes.VectorIndex:
    return indexes.vector_index(read(spark, d, "embeddings").withColumnRenamed("vec_id", "chunk_id"), scratch(spark, "vectors"), cells=32)


@registered(ORACLES["semantic_topk"])
def vector_index_exact(spark: SparkSession, d: str) -> DataFrame:
    """The same list from stored cells, read until no other can hold a nearer row."""
    return _vectors(spark, d).search(query_vector(spark, d), 20)


@registered("SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 100 = 0")
def vector_index_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether PROBES of 32 cells hold at least 0.9 of the ten nearest rows, over every vector whose id is divisible by 100 (against all rows, exactly)."""
    index = _vectors(spark, d)
    asked = [[float(x) for x in r[0]] for r in read(spark, d, "embeddings").filter("vec_id % 100 = 0").select("embedding").collect()]  # a test's stated queries
    return spark.createDataFrame([(len(asked), index.recall(asked, 10, PROBES) >= 0.9)], "queries long, reached boolean")


#: Cells that an approximate search reads, of 32.
PROBES = 24

_SC = "sc AS (SELECT conv_id * 1000000 + turn AS chunk_id, conv_id, turn, role, text, e.embedding::DOUBLE[] AS v FROM conversations JOIN embeddings e ON e.vec_id = (conv_id * 8 + turn) % (SELECT count(*) FROM embeddings))"


def _session_sql(recency: bool = False, n: int = 10, keep: str = "") -> str:
    q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
    have = " AND ".join(f"list_contains(tk, '{w}')" for w in WORDS.split())
    some = "list_filter(tk, lambda t: t IN (" + ", ".join(f"'{w}'" for w in WORDS.split()) + "))"
    rc = ", rc AS (SELECT c.*, row_number() OVER (ORDER BY ts DESC, c.chunk_id) AS rc_rank FROM c JOIN (SELECT chunk_id, to_hours(conv_id::INT) + to_minutes(turn::INT) AS ts FROM sc) USING (chunk_id))" if recency else ""
    return f"""{_SC}, ft0 AS (SELECT chunk_id, len({some})::DOUBLE / len(tk)::DOUBLE AS score FROM (SELECT chunk_id, {_TOKENS.format('text')} AS tk FROM sc) WHERE {have}),
        sm1 AS (SELECT chunk_id, round(1 - list_dot_product(v, {q}) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product({q}, {q}))), 9) AS distance FROM sc), {_lists(2 * n)},
        c AS (SELECT coalesce(ft.chunk_id, sm.chunk_id) AS chunk_id, ft_rank, sm_rank FROM ft FULL OUTER JOIN sm ON ft.chunk_id = sm.chunk_id){rc},
        s AS (SELECT *, coalesce(1::DOUBLE / (60 + ft_rank), 0) + coalesce(1::DOUBLE / (60 + sm_rank), 0){' + 1::DOUBLE / (60 + rc_rank)' if recency else ''} AS score FROM {'rc' if recency else 'c'}),
        hit AS (SELECT s.*, row_number() OVER (ORDER BY s.score DESC, chunk_id) AS place FROM s QUALIFY place <= {n})"""


def session_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Session chunks with a stored vector each."""
    e = read(spark, d, "embeddings").select("vec_id", "embedding")
    return session_chunks(spark, d).withColumn("_v", F.pmod(F.col("session_id") * 8 + F.col("turn_index"), F.lit(e.count()))).join(e, F.col("_v") == F.col("vec_id")).drop("_v", "vec_id")


@registered(f"WITH {_session_sql()} SELECT chunk_id, ft_rank, sm_rank, round(score, 9) AS score, place FROM hit")
def hybrid_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _shown(search.hybrid_search(session_vectors(spark, d), WORDS, query_vector(spark, d)))


@registered(f"WITH {_session_sql(recency=True)} SELECT chunk_id, ft_rank, sm_rank, rc_rank, round(score, 9) AS score, place FROM hit")
def hybrid_sessions_recency(spark: SparkSession, d: str) -> DataFrame:
    return _shown(search.hybrid_search(session_vectors(spark, d), WORDS, query_vector(spark, d), recency_weight=1.0, date=F.col("occurred_at")))


@registered(f"WITH {_session_sql()} SELECT chunk_id, ft_rank, sm_rank, round(score, 9) AS score, place FROM hit")
def hybrid_sessions_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The same answer through both stored indexes, without a scan of texts or vectors."""
    rows = session_vectors(spark, d)
    words, vectors = indexes.lexical_index(rows, scratch(spark, "words")), indexes.vector_index(rows, scratch(spark, "vectors"), cells=32)
    return _shown(search.hybrid_search(rows, WORDS, query_vector(spark, d), words=words, vectors=vectors))


# --- the tools ---------------------------------------------------------------------------------------------------


def engine(spark: SparkSession, d: str) -> api.Engine:
    """The tools over the tables; every query has the vector of id 0."""
    notes = note_chunks(spark, d).withColumns({"source_path": F.col("chunk_id").cast("string"), "section_title": F.lit(None).cast("string")})
    sessions = turns(spark, d).groupBy("session_id").agg(F.min("occurred_at").alias("started_at"), F.max("occurred_at").alias("ended_at"), F.count(F.lit(1)).alias("message_count"))
    return api.Engine(sessions, session_vectors(spark, d).withColumn("is_meta_file", F.lit(False)), notes, FixedEmbedder(query_vector(spark, d)), OverlapReranker())


@registered(f"WITH {_session_sql()} SELECT chunk_id, conv_id AS session_id, turn AS turn_index, role, left(text, 300) AS snippet, turn % 5 = 4 AS is_meta, place FROM hit JOIN sc USING (chunk_id)")
def tool_search_sessions(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).search_sessions(WORDS, 10).drop("occurred_at")


@registered(f"""WITH {_session_sql(n=10)}, k AS (SELECT chunk_id, place AS found, {_TOKENS.format('text')} AS tk FROM hit JOIN sc USING (chunk_id))
    SELECT chunk_id, row_number() OVER (ORDER BY list_contains(tk, 'the')::INT + list_contains(tk, 'and')::INT DESC, found) AS place FROM k QUALIFY place <= 5""")
def tool_search_sessions_reranked(spark: SparkSession, d: str) -> DataFrame:
    """Twice as many hits are fetched, then reranked and cut."""
    return engine(spark, d).search_sessions(WORDS, 5, rerank=True).select("chunk_id", "place")


_MEMORY = ORACLES["hybrid_rrf"]


@registered(f"SELECT h.chunk_id, doc_id::VARCHAR AS source_path, source AS source_type, left(text, 300) AS snippet, place FROM ({_MEMORY}) h JOIN documents ON doc_id = h.chunk_id")
def tool_search_memory(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).search_memory(WORDS, 10).select("chunk_id", "source_path", "source_type", "snippet", "place")


_BOTH = f"""s AS (SELECT 'session' AS kind, 0 AS list, chunk_id, place FROM (WITH {_session_sql(n=10)} SELECT * FROM hit)), m AS (SELECT 'memory' AS kind, 1 AS list, chunk_id, place FROM ({_MEMORY})),
    b AS (SELECT * FROM s UNION ALL SELECT * FROM m)"""


@registered(f"WITH {_BOTH} SELECT kind, chunk_id, row_number() OVER (ORDER BY list, place) AS pos FROM b QUALIFY pos <= 20")
def tool_search_all(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).search_all(WORDS, 20).select("kind", "chunk_id", F.col("at").alias("pos"))


@registered(f"""WITH {_BOTH}, f AS (SELECT 'session' AS kind, conv_id * 1000000 + turn AS chunk_id, text, turn % 5 = 4 AS meta FROM conversations UNION ALL SELECT 'memory', doc_id, text, false FROM documents),
    c AS (SELECT kind, chunk_id, text, row_number() OVER (ORDER BY place, list) AS pos FROM b JOIN f USING (kind, chunk_id) WHERE NOT meta),
    r AS (SELECT *, {_TOKENS.format('text')} AS tk FROM c)
    SELECT kind, chunk_id, left(text, 200) AS snippet, row_number() OVER (ORDER BY list_contains(tk, 'the')::INT + list_contains(tk, 'and')::INT DESC, pos) AS n FROM r QUALIFY n <= 5""")
def answer_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """The hits that an answer cites: hybrid search of both surfaces, talk about the engine hidden, in turn, reranked, cut."""
    hits = engine(spark, d).answer_rows(WORDS, match_count=5)
    return hits.select("kind", "chunk_id", F.substring("content", 1, 200).alias("snippet"), "n")


@registered(f"""WITH h AS ({ORACLES['answer_citations']}) SELECT string_agg(left(snippet, 200) || ' [' || n || ']', chr(10) ORDER BY n) AS answer FROM h""")
def answer_synthesis(spark: SparkSession, d: str) -> DataFrame:
    """The second provider answers where the first one fails."""
    from .catalog import _surfaces

    class Failing:
        def answer(self, hits: DataFrame) -> DataFrame:
            return hits.agg(F.lit(None).cast("string").alias("answer"))

    hits = search.answer_hits(_surfaces(spark, d), WORDS, 10, mode="current")
    return FallbackAnswer(Failing(), Extractive()).answer(hits)


@registered(f"WITH {_SESSIONS} SELECT s.session_id, s.message_count FROM s WHERE session_id = 5")
def tool_get_session(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).get_session(5).select("session_id", "message_count")


@registered("SELECT turn AS turn_index, role, text AS content FROM conversations WHERE conv_id = 4 AND turn BETWEEN 1 AND 3")
def tool_replay_session(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).replay_session(4, 2, 1).select("turn_index", "role", "content")


@registered(f"WITH {_SESSIONS} SELECT session_id, message_count FROM s ORDER BY started_at DESC, session_id LIMIT 12")
def tool_list_sessions(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).list_sessions(limit=12).select("session_id", "message_count")


@registered("""SELECT '{"session_id":' || conv_id || ',"turn_index":' || turn || ',"role":"' || role || '"}' AS hit FROM conversations""")
def json_envelope_hits(spark: SparkSession, d: str) -> DataFrame:
    """Each hit as the tools' JSON has it."""
    return session_chunks(spark, d).select(F.to_json(F.struct("session_id", "turn_index", "role")).alias("hit"))


@registered("SELECT doc_id, term, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents), (VALUES ('license'), ('the')) t(term) WHERE contains(l, term) AND NOT regexp_matches(l, '//\\s*pickaxe-allow\\s*$')")
def pickaxe_scan(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every text that holds a term of a list in a file, which has a comment and blanks."""
    path = scratch(spark, "terms")
    spark.createDataFrame([("# terms",), ("",), (" license ",), ("the",)], "value string").coalesce(1).write.text(path)
    return cli.pickaxe(read(spark, d, "documents").select("doc_id", "text"), files.term_list(spark, path)).withColumn("line", F.col("line").cast("long"))


_HISTORY = "FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents)"


@registered(f"""SELECT DISTINCT 'the' AS term, 'content' AS surface, left(md5(doc_id::VARCHAR), 8) || ':src/f' || (doc_id % 7) || '.md' AS location {_HISTORY} WHERE contains(l, 'the') AND NOT regexp_matches(l, '//\\s*pickaxe-allow\\s*$')
    UNION ALL SELECT DISTINCT 'op://', 'metadata', 'mail op://x' || (doc_id % 3) || '@example.org' FROM documents""")
def history_scan(spark: SparkSession, d: str) -> DataFrame:
    """Texts as the added lines of commits, one commit and file a text, and the people of the commits."""
    docs = read(spark, d, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("t"))
    head = [F.concat(F.md5(F.col("doc_id").cast("string")), F.lit("00000000")), F.lit("diff --git a/x b/x"), F.lit("--- a/x the"), F.concat(F.lit("+++ b/src/f"), (F.col("doc_id") % 7).cast("string"), F.lit(".md")), F.lit("@@ the @@"), F.lit(" the context")]
    log = docs.select("doc_id", F.posexplode(F.concat(F.array(*head), F.transform("t", lambda x: F.concat(F.lit("+"), x)))).alias("line_no", "line"))
    people = docs.select(F.concat(F.lit(" mail op://x"), (F.col("doc_id") % 3).cast("string"), F.lit("@example.org ")).alias("line"))
    rows = history.patch_lines(log, ["doc_id"]).drop("doc_id").unionByName(history.plain_lines(people, "metadata"))
    return history.history_hits(rows, ["the"])


@registered("SELECT conv_id AS session_id, turn AS turn_index, sha256(text) AS content_hash, CASE WHEN turn = 0 THEN conv_id::DOUBLE END AS first_value FROM conversations WHERE conv_id < 3")
def demo_corpus_load(spark: SparkSession, d: str) -> DataFrame:
    """A corpus file of three sessions (what the operator is given, not a cut), its vectors by the contents' hashes."""
    t = turns(spark, d).filter("session_id < 3")
    chunk = F.struct("turn_index", "role", F.col("occurred_at").cast("string").alias("occurred_at"), F.col("text").alias("content"))
    one = t.groupBy("session_id").agg(F.collect_list(chunk).alias("chunks")).select(F.struct(F.col("session_id"), F.lit("x").alias("summary"), F.lit("2024").alias("started_at"), "chunks").alias("s"))
    path = scratch(spark, "demo")
    one.agg(F.to_json(F.struct(F.lit("demo").alias("owner"), F.collect_list("s").alias("sessions"))).alias("value")).coalesce(1).write.text(path)
    firsts = t.filter("turn_index = 0").select("session_id", "text").collect()  # three rows
    vectors = {hashlib.sha256(r["text"].encode()).hexdigest(): [float(r["session_id"]), 1.0] for r in firsts}
    got = jobs.demo_corpus(spark, path, vectors)
    return got.select("session_id", "turn_index", "content_hash", F.when(F.col("turn_index") == 0, F.get("embedding", F.lit(0)).cast("double")).alias("first_value"))


@registered("SELECT user_id, event_id, floor(date_diff('second', ts, TIMESTAMP '2030-01-01') / 36.0) / 100.0 AS hours FROM events")
def event_ages(spark: SparkSession, d: str) -> DataFrame:
    """Hours, to two digits down, until a fixed time."""
    e = read(spark, d, "events")
    return e.select("user_id", "event_id", hour_age(F.col("ts"), F.lit("2030-01-01 00:00:00").cast("timestamp")).alias("hours"))


@registered("SELECT * FROM (VALUES ('limit null', '10'), ('limit 7', '7'), ('limit 0', '1'), ('limit 500', '100'), ('limit abc', 'error'), ('limit 3.5', '3'), ('machine /home/u/x', 'local'), ('machine /srv/x', 'unknown'), ('flags', 'a,b|batch=7,dry-run=True'), ('source b', 'b'), ('source none', 'error')) t(asked, got)")
def argument_checks(spark: SparkSession, d: str) -> DataFrame:
    """Arguments checked and read as the tools and the command line do."""
    def tried(f) -> str:
        try:
            return str(f())
        except (ValueError, TypeError):
            return "error"

    out = [(f"limit {k}", tried(lambda k=k: arguments.clamp_int(k, 1, 100, "limit", 10))) for k in (None, 7, 0, 500, "abc", 3.5)]
    out = [(a.replace("None", "null"), b) for a, b in out]
    where = spark.createDataFrame([("/home/u/x",), ("/srv/x",)], "p string").select("p", files.machine_of(F.col("p"), ["/home/u/"]).alias("m")).collect()
    out += [(f"machine {r['p']}", r["m"]) for r in where]
    positional, flags = arguments.parse_flags(["a", "b", "--batch=7", "--dry-run"])
    out.append(("flags", ",".join(positional) + "|" + ",".join(f"{k}={v}" for k, v in sorted(flags.items()))))
    known = [files.Source(x, "notes", "/x", "m") for x in "ab"]
    out += [(f"source {x}", tried(lambda x=x: files.sources(known, label=x)[0].label)) for x in ("b", "none")]
    return spark.createDataFrame(out, "asked string, got string")


@registered("SELECT doc_id, CASE WHEN length(text) > 400 THEN left(text, 200) || chr(10) || chr(10) || '[...session truncated for context...]' || chr(10) || chr(10) || right(text, 200) ELSE text END AS document FROM documents")
def documents_for_context(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", texts.truncate_document(F.col("text"), 400).alias("document"))


@registered()
def sub_chunk_texts(spark: SparkSession, d: str) -> DataFrame:
    """The chunks' own texts, hashed; test_operators holds the cuts against plain Python."""
    cut = windowing.sub_chunks(read(spark, d, "documents").select("doc_id", "text"))
    return cut.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.sha2("text", 256).alias("text_sha256"))
