"""The registered queries of the engine and their SQL, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import analytics, fulltext, privacy, projection, text as texts, vector
from ..operators import rank, sessions, store, windowing
from ..sources import exports, files, transcripts
from ..streaming import ingest as streaming
from . import ingest, search
from .providers import OverlapReranker
from .tables import note_chunks, query_vector, read, session_chunks, turns

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The lexical query of the search queries.
WORDS = "the and"


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- search ------------------------------------------------------------------------------------------------

_SM = """sm0 AS (SELECT vec_id AS chunk_id, round(1 - list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))
              / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt((SELECT list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) FROM embeddings WHERE vec_id = 0))), 9) AS distance
              FROM embeddings)"""
_TOKENS = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda t: t <> '')"


def _ft(table: str, key: str, text: str, words: str = WORDS, keep: str = "") -> str:
    have = " AND ".join(f"list_contains(tk, '{w}')" for w in words.split())
    some = "list_filter(tk, lambda t: t IN (" + ", ".join(f"'{w}'" for w in words.split()) + "))"
    return f"""ft0 AS (SELECT chunk_id, len({some})::DOUBLE / len(tk)::DOUBLE AS score FROM (SELECT {key} AS chunk_id, {_TOKENS.format(text)} AS tk FROM {table} {keep}) WHERE {have})"""


def _lists(k: int) -> str:
    return f"""ft AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS ft_rank FROM ft0 QUALIFY ft_rank <= {k}),
         sm AS (SELECT chunk_id, row_number() OVER (ORDER BY distance, chunk_id) AS sm_rank FROM sm1 QUALIFY sm_rank <= {k})"""


_NOTES_SM = "sm1 AS (SELECT sm0.* FROM sm0 JOIN documents ON doc_id = chunk_id)"


@registered(f"WITH {_SM} SELECT chunk_id, distance, row_number() OVER (ORDER BY distance, chunk_id) AS rank FROM sm0 ORDER BY distance, chunk_id LIMIT 20")
def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    return rank.semantic_topk(rows, query_vector(spark, d), 20)


@registered(f"WITH {_ft('documents', 'doc_id', 'text')} SELECT chunk_id, round(score, 9) AS score FROM ft0")
def lexical_match(spark: SparkSession, d: str) -> DataFrame:
    some = note_chunks(spark, d).filter(fulltext.could_match(F.col("content"), WORDS))
    rows = some.select("chunk_id", fulltext.tokens(F.col("content")).alias("t")).filter(fulltext.matches(F.col("t"), WORDS))
    return rows.select("chunk_id", F.round(fulltext.score(F.col("t"), WORDS), 9).alias("score"))


@registered(f"""SELECT doc_id AS chunk_id FROM (SELECT doc_id, {_TOKENS.format('text')} AS tk FROM documents)
    WHERE (contains(' ' || array_to_string(tk, ' ') || ' ', ' of the ') AND NOT list_contains(tk, 'und')) OR list_contains(tk, 'para')""")
def lexical_web_query(spark: SparkSession, d: str) -> DataFrame:
    """Phrase, exclusion and alternative."""
    return note_chunks(spark, d).filter(fulltext.matches(fulltext.tokens(F.col("content")), '"of the" -und or para')).select("chunk_id")


@registered(f"WITH {_ft('documents', 'doc_id', 'text')} SELECT chunk_id, round(score, 9) AS score, row_number() OVER (ORDER BY ft0.score DESC, chunk_id) AS rank FROM ft0 QUALIFY rank <= 20")
def lexical_topk(spark: SparkSession, d: str) -> DataFrame:
    return rank.lexical_topk(note_chunks(spark, d), WORDS, 20).withColumn("score", F.round("score", 9))


@registered()
def lexical_english_topk(spark: SparkSession, d: str) -> DataFrame:
    """Stems and cover density: no SQL; tests hold it against a plain sweep."""
    return rank.english_topk(note_chunks(spark, d), "tion ing", 20)


def _hybrid_sql(k: float, wf: float, ws: float, keep: str = "", n: int = 10, extra: str = "", score: str = "", columns: str = "") -> str:
    sm = _NOTES_SM if not keep else f"sm1 AS (SELECT sm0.* FROM sm0 JOIN documents ON doc_id = chunk_id {keep})"
    return f"""WITH {_SM}, {sm}, {_ft('documents', 'doc_id', 'text', keep=keep)}, {_lists(2 * n)},
        c AS (SELECT coalesce(ft.chunk_id, sm.chunk_id) AS chunk_id, ft_rank, sm_rank FROM ft FULL OUTER JOIN sm ON ft.chunk_id = sm.chunk_id){extra},
        s AS (SELECT c.*, coalesce({wf}::DOUBLE / ({k}::DOUBLE + ft_rank), 0) + coalesce({ws}::DOUBLE / ({k}::DOUBLE + sm_rank), 0){score} AS score FROM {'rc AS c' if extra else 'c'})
        SELECT chunk_id, ft_rank, sm_rank, {columns} round(score, 9) AS score, row_number() OVER (ORDER BY s.score DESC, chunk_id) AS place FROM s QUALIFY place <= {n}"""


def _shown(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", 9))


@registered(_hybrid_sql(60, 1, 1))
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return _shown(search.hybrid_search(note_chunks(spark, d), WORDS, query_vector(spark, d)))


@registered(_hybrid_sql(50, 1, 1))
def hybrid_rrf_plain(spark: SparkSession, d: str) -> DataFrame:
    return _shown(search.hybrid_search(note_chunks(spark, d), WORDS, query_vector(spark, d), rrf_k=rank.RRF_K_PLAIN))


@registered(_hybrid_sql(60, 1, 0))
def hybrid_weights_lexical_only(spark: SparkSession, d: str) -> DataFrame:
    return _shown(search.hybrid_search(note_chunks(spark, d), WORDS, query_vector(spark, d), semantic_weight=0))


@registered(_hybrid_sql(60, 0, 1))
def hybrid_weights_semantic_only(spark: SparkSession, d: str) -> DataFrame:
    return _shown(search.hybrid_search(note_chunks(spark, d), WORDS, query_vector(spark, d), full_text_weight=0))


@registered(_hybrid_sql(60, 1, 1, keep="WHERE source = 'src3'"))
def hybrid_rrf_facet(spark: SparkSession, d: str) -> DataFrame:
    return _shown(search.hybrid_search(note_chunks(spark, d), WORDS, query_vector(spark, d), owner="owner", source_type="src3"))


@registered(_hybrid_sql(
    60, 1, 1, extra=", rc AS (SELECT c.*, row_number() OVER (ORDER BY c.chunk_id DESC) AS rc_rank FROM c)",
    score=" + 1::DOUBLE / (60::DOUBLE + rc_rank)", columns="rc_rank,",
))
def hybrid_rrf_recency(spark: SparkSession, d: str) -> DataFrame:
    """A note's date grows with its id."""
    return _shown(search.hybrid_search(note_chunks(spark, d), WORDS, query_vector(spark, d), recency_weight=1.0, date=F.col("last_modified")))


_PLACED = """s AS (SELECT conv_id * 1000000 + turn AS id, left(text, 300) AS snippet, row_number() OVER (ORDER BY length(text) DESC, conv_id, turn) AS place FROM conversations QUALIFY place <= 20),
    n AS (SELECT doc_id AS id, left(text, 300) AS snippet, row_number() OVER (ORDER BY length(text) DESC, doc_id) AS place FROM documents QUALIFY place <= 20),
    b AS (SELECT 'session' AS kind, 0 AS list, * FROM s UNION ALL SELECT 'memory', 1, * FROM n)"""


def _surfaces(spark: SparkSession, d: str, k: int = 20) -> list[DataFrame]:
    """The longest texts of both surfaces, as two ranked lists."""
    out = []
    for kind, rows in (("session", session_chunks(spark, d)), ("memory", note_chunks(spark, d))):
        top = rows.select(F.col("chunk_id").alias("id"), F.length("content").alias("size"), "content").orderBy(F.desc("size"), "id").limit(k)
        place = F.row_number().over(Window.orderBy(F.desc("size"), "id")).cast("long")
        out.append(top.select("id", "content", place.alias("place"), F.lit(kind).alias("kind")))
    return out


@registered(f"WITH {_PLACED} SELECT kind, id, snippet, row_number() OVER (ORDER BY list, place) AS pos FROM b WHERE place <= 8 QUALIFY pos <= 15")
def search_all_concat(spark: SparkSession, d: str) -> DataFrame:
    found = search.search_all(*_surfaces(spark, d), limit=15)
    return found.select("kind", "id", texts.snippet(F.col("content")).alias("snippet"), F.col("at").alias("pos"))


@registered(f"WITH {_PLACED} SELECT kind, id, row_number() OVER (ORDER BY place, list) AS pos FROM b QUALIFY pos <= 10")
def answer_round_robin(spark: SparkSession, d: str) -> DataFrame:
    return search.answer_hits(_surfaces(spark, d), WORDS, match_count=10, mode="current").select("kind", "id", F.col("at").alias("pos"))


@registered(f"""WITH {_PLACED}, c AS (SELECT kind, id, row_number() OVER (ORDER BY place, list) AS pos FROM b),
    t AS (SELECT c.*, {_TOKENS.format('f.text')} AS tk FROM c JOIN (SELECT 'session' AS kind, conv_id * 1000000 + turn AS id, text FROM conversations UNION ALL SELECT 'memory', doc_id, text FROM documents) f USING (kind, id)),
    r AS (SELECT kind, id, pos, (list_contains(tk, 'the')::INT + list_contains(tk, 'and')::INT)::DOUBLE / 2 AS rerank_score FROM t)
    SELECT kind, id, rerank_score, row_number() OVER (ORDER BY rerank_score DESC, pos) AS n FROM r QUALIFY n <= 10""")
def answer_reranked(spark: SparkSession, d: str) -> DataFrame:
    return search.answer_hits(_surfaces(spark, d), WORDS, 10, reranker=OverlapReranker()).select("kind", "id", "rerank_score", "n")


@registered(f"""WITH {_PLACED}, c AS (SELECT *, row_number() OVER (ORDER BY place, list) AS n FROM b QUALIFY n <= 10)
    SELECT n, kind, CASE WHEN kind = 'session' THEN id // 1000000 END AS session_id, CASE WHEN kind = 'memory' THEN id END AS source_path,
           CASE WHEN kind = 'session' THEN id % 1000000 END AS turn_index, left(snippet, 200) AS snippet FROM c""")
def answer_citations(spark: SparkSession, d: str) -> DataFrame:
    hits = search.answer_hits(_surfaces(spark, d), WORDS, 10, mode="current")
    session, note = F.col("kind") == "session", F.col("kind") == "memory"
    hit = {
        "n": F.col("n"), "kind": F.col("kind"), "session_id": F.when(session, F.floor(F.col("id") / 1_000_000).cast("long")), "source_path": F.when(note, F.col("id")),
        "turn_index": F.when(session, F.col("id") % 1_000_000), "occurred_at": F.lit(None).cast("string"), "content": F.col("content"),
    }
    return hits.select(search.citation(hit).alias("c")).select("c.n", "c.kind", "c.session_id", "c.source_path", "c.turn_index", "c.snippet")


@registered("""SELECT conv_id * 1000000 + turn AS chunk_id, '[' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) || '] session=' || left(conv_id::VARCHAR, 8) || ' turn=' || turn || ' role=' || role || ' date='
    || strftime(TIMESTAMP '2024-01-01' + to_hours(conv_id::INT) + to_minutes(turn::INT), '%Y-%m-%d') || chr(10) || left(text, 1500) AS line FROM conversations""")
def synthesis_prompt(spark: SparkSession, d: str) -> DataFrame:
    rows = session_chunks(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy("turn_index")))
    line = search.prompt_line(F.col("n"), F.col("session_id").cast("string"), F.col("turn_index"), F.col("role"), F.date_format("occurred_at", "yyyy-MM-dd"), F.col("content"))
    return rows.select("chunk_id", line.alias("line"))


@registered(r"""SELECT doc_id AS chunk_id, '[' || doc_id || '] memory source=' || doc_id || ' type=' || source || ' mtime='
    || strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id::INT), '%Y-%m-%d') || chr(10) || left(text, 1500) AS line FROM documents""")
def synthesis_prompt_notes(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("chunk_id").cast("string")
    line = search.note_line(F.col("chunk_id"), key, F.col("source_type"), F.date_format("last_modified", "yyyy-MM-dd"), F.col("content"))
    return note_chunks(spark, d).select("chunk_id", line.alias("line"))


@registered(r"""SELECT conv_id, turn, CASE WHEN regexp_matches(q, '(?i)\b(?:current(?:ly)?|now|today|latest|recent(?:ly)?|ongoing|still|where (?:are we|do we stand|am i)|what''?s? (?:left|next|the (?:current|latest) (?:state|status))|(?:status|state) (?:of|on)|right now|as of (?:now|today))\b')
    THEN 'current' ELSE 'balanced' END AS mode FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'what is next for ' WHEN 1 THEN 'the latest on ' WHEN 2 THEN 'unstill nowhere ' ELSE 'status of ' END || regexp_replace(text, '[^A-Za-z ]', '', 'g') AS q FROM conversations)""")
def search_mode_detect(spark: SparkSession, d: str) -> DataFrame:
    lead = F.when(F.col("turn_index") % 4 == 0, "what is next for ").when(F.col("turn_index") % 4 == 1, "the latest on ").when(F.col("turn_index") % 4 == 2, "unstill nowhere ").otherwise("status of ")
    q = F.concat(lead, F.regexp_replace("text", "[^A-Za-z ]", ""))
    return turns(spark, d).select(F.col("session_id").alias("conv_id"), F.col("turn_index").alias("turn"), texts.search_mode(q).alias("mode"))


@registered("""SELECT chunk_id, place FROM (SELECT conv_id * 1000000 + turn AS chunk_id, turn, row_number() OVER (ORDER BY length(text) DESC, conv_id, turn) AS place FROM conversations QUALIFY place <= 30) WHERE turn % 5 <> 4""")
def hide_meta_after_limit(spark: SparkSession, d: str) -> DataFrame:
    rows = session_chunks(spark, d).withColumns({"size": F.length("content"), "is_meta_file": F.lit(False)})
    top = rows.orderBy(F.desc("size"), "chunk_id").limit(30).withColumn("place", F.row_number().over(Window.orderBy(F.desc("size"), "chunk_id")).cast("long"))
    return search.hide_meta(top).select("chunk_id", "place")


@registered("""SELECT conv_id * 1000000 + turn AS chunk_id, conv_id AS session_id, turn AS turn_index, role, left(text, 300) AS snippet, left(regexp_replace(text, '\\s+', ' ', 'g'), 300) AS shown, turn % 5 = 4 AS is_meta FROM conversations""")
def compact_hits(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return session_chunks(spark, d).select("chunk_id", "session_id", "turn_index", "role", texts.snippet(c).alias("snippet"), texts.shown_snippet(c).alias("shown"), F.col("is_meta_message").alias("is_meta"))


# --- sessions ----------------------------------------------------------------------------------------------

_SESSIONS = """s AS (SELECT conv_id AS session_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS message_count FROM
    (SELECT conv_id, TIMESTAMP '2024-01-01' + to_hours(conv_id::INT) + to_minutes(turn::INT) AS ts FROM conversations) GROUP BY conv_id)"""


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions.rollup(turns(spark, d), "session_id", "turn_index", "occurred_at")


@registered("""SELECT conv_id AS session_id, strftime(min(ts), '%Y-%m-%d %H:%M') AS started_at, strftime(max(ts), '%Y-%m-%d %H:%M') AS ended_at, count(*) AS message_count,
    arg_min(role, turn) AS project_path, arg_max(sha256(text), turn) FILTER (WHERE role = 'assistant') AS summary_sha256
    FROM (SELECT *, TIMESTAMP '2024-01-01' + to_hours(conv_id::INT) + to_minutes(turn::INT) AS ts FROM conversations) GROUP BY conv_id""")
def session_rollup(spark: SparkSession, d: str) -> DataFrame:
    """The first role stands for the first working folder, all of the last assistant's words, hashed, for the last title."""
    t = turns(spark, d).withColumns({"at": F.date_format("occurred_at", "yyyy-MM-dd HH:mm"), "title": F.when(F.col("role") == "assistant", F.sha2("text", 256))})
    return sessions.rollup(t, "session_id", "turn_index", "at", "role", "title").withColumnRenamed("summary", "summary_sha256")


@registered(f"WITH {_SESSIONS} SELECT * FROM s WHERE started_at >= TIMESTAMP '2024-01-01 05:00:00' ORDER BY started_at DESC NULLS FIRST, session_id LIMIT 25 OFFSET 5")
def list_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions.list_sessions(_sessions(spark, d), 25, 5, since="2024-01-01 05:00:00")


@registered(f"WITH {_SESSIONS} SELECT * FROM s WHERE session_id = 7")
def get_session(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).filter("session_id = 7")


@registered("SELECT turn AS turn_index, role, text FROM conversations WHERE conv_id = 3 AND turn BETWEEN 0 AND 5")
def replay_window(spark: SparkSession, d: str) -> DataFrame:
    return sessions.replay(turns(spark, d), 3, around=2, window=3).select("turn_index", "role", "text")


_STATS = ["documents", "conversations", "embeddings", "events"]


@registered(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _STATS))
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t in _STATS:
        one = read(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n")
        out = one if out is None else out.union(one)
    return out


@registered("""SELECT count(*) AS total, count(*) FILTER (turn % 3 = 0) AS with_prefix, count(*) FILTER (turn % 3 = 1) AS failed, count(*) FILTER (turn % 3 = 2) AS opted_out,
    round(count(*) FILTER (turn % 3 = 0) * 100.0::DOUBLE / count(*), 1) AS percent FROM conversations""")
def cr_coverage(spark: SparkSession, d: str) -> DataFrame:
    return session_chunks(spark, d).agg(*sessions.coverage(F.col("has_cr_prefix")))


@registered("SELECT conv_id * 1000000 + turn AS chunk_id FROM conversations WHERE turn % 3 <> 0")
def needs_backfill(spark: SparkSession, d: str) -> DataFrame:
    """The flag is distinct from true."""
    return session_chunks(spark, d).filter(~F.coalesce("has_cr_prefix", F.lit(False))).select("chunk_id")


_LINES = """l AS (SELECT doc_id, i - 1 AS turn_index, x[i] AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i)),
    p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn_index) - 1 AS p, count(*) OVER (PARTITION BY doc_id) AS n FROM l),
    k AS (SELECT * FROM p WHERE n <= 8 OR regexp_matches(content, '(?i)\\[Tool error\\]|\\b(?:decided|decision)\\b')
          OR list_contains(list_transform(range(0, greatest(2, least(4, n))::BIGINT), lambda i: floor(i * (n - 1) / (greatest(2, least(4, n)) - 1)::DOUBLE + 0.5)::BIGINT), p))"""


def _line_chunks(spark: SparkSession, d: str) -> DataFrame:
    cut = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("turn_index", "content"))
    return sessions.distill_sample(cut, "doc_id", most=4, threshold=8)


@registered(f"WITH {_LINES} SELECT doc_id, turn_index, length(content) AS chars FROM k")
def distill_sample(spark: SparkSession, d: str) -> DataFrame:
    return _line_chunks(spark, d).select("doc_id", F.col("turn_index").cast("long").alias("turn_index"), F.length("content").cast("long").alias("chars"))


@registered(f"WITH {_LINES} SELECT doc_id, sha256(left(string_agg('[turn ' || turn_index || '] ' || content, chr(10) || chr(10) ORDER BY turn_index), 24000)) AS prompt_sha256 FROM k GROUP BY doc_id")
def distill_prompt(spark: SparkSession, d: str) -> DataFrame:
    return sessions.distill_prompt(_line_chunks(spark, d), "doc_id").select("doc_id", F.sha2("prompt", 256).alias("prompt_sha256"))


@registered("""SELECT source, sum(t)::BIGINT AS tokens, round(sum(t) * 0.12::DOUBLE / 1e6, 9) AS embed_cost,
    round((greatest(0, sum(t) - sum(r)) * 0.25::DOUBLE + sum(r) * (0.25::DOUBLE * 0.1) + 0 * 0.3125::DOUBLE + sum(r) * 1.25::DOUBLE) / 1e6, 9) AS prefix_cost
    FROM (SELECT source, ceil(length(text) / 3.5)::BIGINT AS t, length(text) // 10 AS r FROM documents) GROUP BY source""")
def cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("source", texts.estimated_tokens(F.col("text")).alias("t"), F.expr("length(text) div 10").alias("r"))
    sums = rows.groupBy("source").agg(F.sum("t").alias("tokens"), F.sum("r").alias("r"))
    t, r = F.col("tokens"), F.col("r")
    return sums.select("source", "tokens", F.round(sessions.cost(t, F.lit(0), 0.12, 0.0), 9).alias("embed_cost"), F.round(sessions.cost(t, r, 0.25, 1.25, cache_read=r), 9).alias("prefix_cost"))


@registered("""SELECT count(*) AS sampled, round(avg(t), 6) AS avg_tokens, round(avg(t) * (SELECT count(DISTINCT conv_id) FROM conversations), 3) AS projected FROM
    (SELECT conv_id, sum(ceil(length(text) / 3.5)::BIGINT)::DOUBLE AS t FROM conversations GROUP BY conv_id ORDER BY conv_id LIMIT 150)""")
def cost_projection(spark: SparkSession, d: str) -> DataFrame:
    """The dry run's estimate: the mean of up to 150 sessions, carried on to all."""
    per = turns(spark, d).groupBy("session_id").agg(F.sum(texts.estimated_tokens(F.col("text"))).cast("double").alias("t"))
    total = per.agg(F.count(F.lit(1)).alias("all"))
    some = per.orderBy("session_id").limit(150).agg(F.count(F.lit(1)).alias("sampled"), F.avg("t").alias("mean"))
    return some.crossJoin(total).select("sampled", F.round("mean", 6).alias("avg_tokens"), F.round(F.col("mean") * F.col("all"), 3).alias("projected"))


# --- windows and chunks ------------------------------------------------------------------------------------

_WINDOWS = """RECURSIVE t AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
    f AS (SELECT a.conv_id, a.i, b.i - a.i + 1 AS k, sum(b.n) OVER w + 2 * (b.i - a.i) AS chars, max(b.n) OVER w AS widest FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.i BETWEEN a.i AND a.i + 7
          WINDOW w AS (PARTITION BY a.conv_id, a.i ORDER BY b.i)),
    w AS (SELECT conv_id, i, max(k) AS size FROM (SELECT *, bool_and(k = 1 OR (widest <= 3200 AND (k <= 3 OR chars <= 3200))) OVER (PARTITION BY conv_id, i ORDER BY k) AS ok FROM f) WHERE ok GROUP BY ALL),
    s AS (SELECT w.*, t.turn, n > 3200 AS over, CASE WHEN n > 3200 THEN w.i + 1 ELSE greatest(w.i + 1, w.i + size - 1) END AS after FROM w JOIN t USING (conv_id, i)),
    r AS (SELECT * FROM s WHERE i = 0 UNION ALL SELECT s.* FROM r JOIN s ON s.conv_id = r.conv_id AND s.i = r.after)"""


@registered(f"""WITH {_WINDOWS} SELECT r.conv_id AS session_id, r.turn AS first_turn, max(c.turn) AS last_turn, r.size AS window_size, any_value(r.over) AS oversized,
    sha256(string_agg(c.text, chr(10) || chr(10) ORDER BY c.turn)) AS text_sha256 FROM r JOIN t ON t.conv_id = r.conv_id AND t.i BETWEEN r.i AND r.i + r.size - 1 JOIN conversations c ON c.conv_id = t.conv_id AND c.turn = t.turn
    GROUP BY r.conv_id, r.turn, r.size""")
def turn_windows(spark: SparkSession, d: str) -> DataFrame:
    w = windowing.turn_windows(turns(spark, d))
    return w.select("session_id", "first_turn", "last_turn", F.col("window_size").cast("long").alias("window_size"), "oversized", F.sha2("text", 256).alias("text_sha256"))


@registered(f"""WITH {_WINDOWS} SELECT r.conv_id AS session_id, r.turn AS turn_index, CASE WHEN r.size = 1 THEN any_value(c.role) ELSE 'mixed' END AS role, max(c.turn) AS end_turn_index, r.size AS window_size,
    bool_or(c.turn % 5 = 4) AS is_meta_message, sha256(string_agg(c.text, chr(10) || chr(10) ORDER BY c.turn)) AS content_hash
    FROM r JOIN t ON t.conv_id = r.conv_id AND t.i BETWEEN r.i AND r.i + r.size - 1 JOIN conversations c ON c.conv_id = t.conv_id AND c.turn = t.turn GROUP BY r.conv_id, r.turn, r.size
    QUALIFY row_number() OVER (PARTITION BY r.conv_id, content_hash ORDER BY r.turn) = 1""")
def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d).withColumns({"tools_called": F.array().cast("array<string>"), "is_meta_message": F.col("turn_index") % 5 == 4})
    c = ingest.ingest(t, None, "batch").chunks
    return c.select("session_id", "turn_index", "role", "metadata.end_turn_index", F.col("metadata.window_size").cast("long").alias("window_size"), "metadata.is_meta_message", "content_hash")


_SUB = """RECURSIVE r AS (SELECT doc_id, text, length(text) AS n, 0 AS pos, -1 AS chunk_no, 0 AS s, 0 AS e FROM documents WHERE length(text) > 0
    UNION ALL SELECT doc_id, text, n, CASE WHEN e2 >= n THEN n WHEN e2 - 200 > pos THEN e2 - 200 ELSE e2 END, chunk_no + 1, pos, e2 FROM (
      SELECT *, CASE WHEN pos + 3200 >= n THEN n WHEN contains(p2, chr(10) || chr(10)) AND l2 > pos + 1600 THEN least(n, l2 + 2) WHEN contains(p1, chr(10)) AND l1 > pos + 1600 THEN least(n, l1 + 1) ELSE pos + 3200 END AS e2 FROM (
        SELECT *, substr(text, pos + 1, 3202) AS p2, substr(text, pos + 1, 3201) AS p1, pos + 3200 - (instr(reverse(substr(text, pos + 1, 3202)), chr(10) || chr(10)) - 1) AS l2, pos + 3200 - (instr(reverse(substr(text, pos + 1, 3201)), chr(10)) - 1) AS l1 FROM r WHERE pos < n)))"""


@registered(f"WITH {_SUB} SELECT doc_id, chunk_no::BIGINT AS chunk_no, s::BIGINT AS start_char, e::BIGINT AS end_char FROM r WHERE chunk_no >= 0")
def sub_chunks(spark: SparkSession, d: str) -> DataFrame:
    cut = windowing.sub_chunks(read(spark, d, "documents").select("doc_id", "text"))
    return cut.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("chunk_no", "start_char", "end_char")])


_BIG = """b AS (SELECT doc_id, text || chr(10) || chr(10) || '## ' || text AS text FROM documents WHERE length(trim(text)) > 0)"""
_TRIMMED = r"regexp_replace({0}, '^[\s]+|[\s]+$', '', 'g')"


def _big(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return read(spark, d, "documents").filter(F.length(F.trim(t)) > 0).select("doc_id", F.concat(t, F.lit("\n\n## "), t).alias("text"))


@registered(f"""WITH RECURSIVE {_BIG}, r AS (SELECT doc_id, text, length(text) AS n, 0 AS pos, 0 AS s FROM b WHERE length(text) > 8000
    UNION ALL SELECT doc_id, text, n, CASE WHEN pos + 6000 < n AND contains(p, chr(10) || chr(10)) AND l > pos + 3000 THEN l + 2 ELSE least(pos + 6000, n) END, pos FROM (
      SELECT *, substr(text, pos + 1, 6002) AS p, pos + least(6002, n - pos) - instr(reverse(substr(text, pos + 1, 6002)), chr(10) || chr(10)) - 1 AS l FROM r WHERE pos < n)),
    c AS (SELECT doc_id, s, {_TRIMMED.format('substr(text, s + 1, pos - s)')} AS content FROM r WHERE pos > 0 UNION ALL SELECT doc_id, 0, {_TRIMMED.format('text')} FROM b WHERE length(text) <= 8000)
    SELECT doc_id, sha256(content) AS content_sha256, length(content) AS chars FROM c WHERE length(content) > 20 OR (s = 0 AND doc_id IN (SELECT doc_id FROM b WHERE length(text) <= 8000))""")
def md_split_oversized(spark: SparkSession, d: str) -> DataFrame:
    cut = windowing.markdown_chunks(_big(spark, d))
    return cut.select("doc_id", F.sha2("content", 256).alias("content_sha256"), F.length("content").cast("long").alias("chars"))


@registered(f"""WITH b AS (SELECT doc_id, regexp_replace(text, '\\n', chr(10) || '----' || chr(10)) AS text FROM documents WHERE length(trim(text)) > 0),
    c AS (SELECT doc_id, {_TRIMMED.format('unnest(string_split_regex(text, chr(10) || ' + "'---+'" + ' || chr(10)))')} AS content FROM b)
    SELECT doc_id, content FROM c WHERE length(content) > 20""")
def md_hr_split(spark: SparkSession, d: str) -> DataFrame:
    """The first line break of each document becomes a rule."""
    rows = read(spark, d, "documents").filter(F.length(F.trim("text")) > 0)
    at = F.instr("text", "\n")
    marked = F.when(at > 0, F.concat(F.substring("text", F.lit(1), at - 1), F.lit("\n----\n"), F.expr("substring(text, instr(text, '\n') + 1)"))).otherwise(F.col("text"))
    return windowing.markdown_chunks(rows.select("doc_id", marked.alias("text")), chunk_by="hr-separator").select("doc_id", "content")


@registered(f"""WITH {_BIG}, c AS (SELECT doc_id, {_TRIMMED.format("unnest(string_split(replace(text, chr(10) || '## ', chr(10) || chr(1) || '## '), chr(1)))")} AS content FROM b)
    SELECT doc_id, sha256(content) AS content_sha256, CASE WHEN starts_with(content, '## ') THEN nullif(left({_TRIMMED.format("string_split(substr(content, 4), chr(10))[1]")}, 200), '') END AS section_title FROM c WHERE length(content) > 20""")
def md_h2_split(spark: SparkSession, d: str) -> DataFrame:
    cut = windowing.markdown_chunks(_big(spark, d), chunk_by="h2-section")
    return cut.select("doc_id", F.sha2("content", 256).alias("content_sha256"), "section_title")


@registered(f"""SELECT doc_id, nullif(left({_TRIMMED.format("regexp_extract('# ' || text, '(?m)^#+[ \\t]+([^\\n]+)$', 1)")}, 200), '') AS heading FROM documents""")
def md_first_heading(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", texts.first_heading(F.concat(F.lit("# "), F.col("text"))).alias("heading"))


@registered("""WITH RECURSIVE t AS (SELECT source, ceil(length(text) / 3.5)::BIGINT AS n, doc_id, row_number() OVER (PARTITION BY source, doc_id // 100000 ORDER BY doc_id) AS i, doc_id // 100000 AS block FROM documents),
    r AS (SELECT source, block, i, doc_id, 0 AS batch, 1 AS items, n AS tokens FROM t WHERE i = 1 UNION ALL
      SELECT t.source, t.block, t.i, t.doc_id, CASE WHEN full_ THEN batch + 1 ELSE batch END, CASE WHEN full_ THEN 1 ELSE items + 1 END, CASE WHEN full_ THEN t.n ELSE tokens + t.n END
      FROM (SELECT r.*, items >= 16 OR tokens + t2.n > 20000 AS full_ FROM r JOIN t t2 ON t2.source = r.source AND t2.block = r.block AND t2.i = r.i + 1) q JOIN t ON t.source = q.source AND t.block = q.block AND t.i = q.i + 1)
    SELECT source, doc_id, batch FROM r""")
def embed_batches(spark: SparkSession, d: str) -> DataFrame:
    """Greedy batches in id order, one running fold over each source; blocks of ids only share out the work. The SQL starts anew at each 100,000 ids, so the two agree below that where no text, source or id is null."""
    rows = read(spark, d, "documents").select("source", "doc_id", F.coalesce(texts.estimated_tokens(F.col("text")), F.lit(0)).cast("long").alias("n"), F.expr("doc_id div 100000").alias("block"))
    return windowing.running_batches(rows, "source", "doc_id", "n", "block", 16, 20_000)


# --- writes ------------------------------------------------------------------------------------------------

@registered("SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash, count(*) AS copies FROM documents GROUP BY sha256(text)")
def content_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return rows.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@registered("""SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE NOT EXISTS (SELECT 1 FROM documents s WHERE s.lang = 'en' AND sha256(s.text) = sha256(documents.text))""")
def incremental_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """The English documents are stored; all documents come in."""
    rows = read(spark, d, "documents").select("lang", F.sha2("text", 256).alias("content_hash"))
    return store.new_rows(rows, rows.filter("lang = 'en'"), ["content_hash"]).select("content_hash")


@registered("""WITH s AS (SELECT conv_id AS session_id, role, text AS summary, turn AS version FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1),
    i AS (SELECT conv_id AS session_id, text AS summary, turn AS version FROM conversations WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)
    SELECT coalesce(s.session_id, i.session_id) AS session_id, s.role, coalesce(i.summary, s.summary) AS summary, coalesce(i.version, s.version) AS version FROM s FULL JOIN i ON s.session_id = i.session_id""")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """Each session's first question is stored; all answers come in, the last wins."""
    t = turns(spark, d).select("session_id", "role", F.col("text").alias("summary"), F.col("turn_index").alias("version"))
    stored = store.first_of_each(t.filter("role = 'user'"), ["session_id"], [F.col("version").asc()])
    return store.upsert(stored, t.filter("role = 'assistant'"), "session_id", F.col("version"), ["summary", "version"])


@registered("""SELECT conv_id AS session_id, min(turn) AS started_at, CASE WHEN bool_or(role = 'system') THEN 'patched ' || conv_id END AS summary FROM conversations GROUP BY conv_id""")
def patch_rows(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with a system turn get a summary."""
    t = turns(spark, d)
    s = t.groupBy("session_id").agg(F.min("turn_index").alias("started_at")).withColumn("summary", F.lit(None).cast("string"))
    changes = t.filter("role = 'system'").select("session_id", F.concat(F.lit("patched "), F.col("session_id").cast("string")).alias("summary")).distinct()
    return store.patch(s, changes, "session_id")


@registered("SELECT conv_id * 1000000 + turn AS chunk_id FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) > 5)")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    c = session_chunks(spark, d)
    return store.without(c, c.groupBy("session_id").count().filter("count > 5"), "session_id").select("chunk_id")


_NEEDLE = """text || CASE WHEN doc_id % 17 = 0 THEN ' sk-ant-' || repeat('a1', 12) || doc_id WHEN doc_id % 17 = 1 THEN ' password: "hunter' || doc_id || '"' WHEN doc_id % 17 = 2 THEN ' postgres://u' || doc_id || ':pw@db/x' WHEN doc_id % 17 = 3 THEN ' ' || 'AKIA' || '0123456789ABCDEF ' ELSE '' END"""
_SCANNED = """n AS (SELECT doc_id, source, {0} AS text FROM documents), v AS (SELECT *, CASE {1} END AS reason, left(CASE {2} END, 80) AS matched FROM n)""".format(
    _NEEDLE,
    " ".join("WHEN regexp_extract(text, '{0}') <> '' THEN '{1}'".format(p.replace("'", "''"), r) for r, p in privacy.PATTERNS),
    " ".join("WHEN regexp_extract(text, '{0}') <> '' THEN regexp_extract(text, '{0}')".format(p.replace("'", "''")) for _, p in privacy.PATTERNS),
)


def _needles(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("doc_id", "source", F.expr(_NEEDLE).alias("text"))
    return rows.withColumn("v", privacy.scan(F.col("text")))


@registered(f"WITH {_SCANNED} SELECT doc_id, reason IS NULL AS pass, reason, matched FROM v")
def privacy_scan(spark: SparkSession, d: str) -> DataFrame:
    return _needles(spark, d).select("doc_id", "v.pass", "v.reason", "v.matched")


@registered(f"""WITH {_SCANNED} SELECT doc_id, '[quarantined] reason=' || reason || ' sha256=' || sha256('{privacy.SALT}' || matched) || ' prefix=' || left(matched, 6) || ' len=' || length(matched) AS content,
    reason, left(matched, 8) AS matched_pattern FROM v WHERE reason IS NOT NULL""")
def quarantine_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = _needles(spark, d).filter("not v.pass")
    return rows.select("doc_id", privacy.quarantined_content(F.col("v.reason"), F.col("v.matched")).alias("content"), "v.reason", privacy.matched_prefix(F.col("v.matched")).alias("matched_pattern"))


@registered(f"WITH {_SCANNED} SELECT source AS source_path, matched AS content, min(doc_id) AS quarantine_id FROM v WHERE reason IS NOT NULL GROUP BY source, matched")
def quarantine_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = _needles(spark, d).filter("not v.pass").select(F.col("source").alias("source_path"), F.col("v.matched").alias("content"), F.col("doc_id").alias("quarantine_id"), F.lit(0).alias("created_at"))
    return store.quarantine_distinct(rows).select("source_path", "content", "quarantine_id")


# --- text --------------------------------------------------------------------------------------------------

@registered(r"SELECT doc_id, sha256(regexp_replace(chr(7) || replace(text, 'e', chr(2) || 'e' || chr(65533)), '[\x01-\x08\x0B\x0C\x0E-\x1F\x{FFFD}]', '', 'g')) AS text_sha256 FROM documents")
def sanitize_text(spark: SparkSession, d: str) -> DataFrame:
    dirty = F.concat(F.char(F.lit(7)), F.replace(F.col("text"), F.lit("e"), F.lit("\x02e�")))
    return read(spark, d, "documents").select("doc_id", F.sha2(texts.sanitize(dirty), 256).alias("text_sha256"))


@registered(r"""WITH r AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace('at /home/ann/x and /home/annex by ann for proj' || doc_id % 3 || ' key op://vault/k' || doc_id || ' ' || coalesce(text, ''),
    'op://\S+', '<secret-ref>', 'g'), 'proj1', '<project-ref>'), '/home/ann(/|$)', '$HOME\1', 'g'), '\bann\b', '<user>', 'g'), '\bthe\b', '<name>', 'g') AS t FROM documents) SELECT doc_id, length(t) AS chars, sha256(t) AS scrubbed_sha256 FROM r""")
def identity_scrub(spark: SparkSession, d: str) -> DataFrame:
    """The whole text, as it stands, after a head that holds what is to be scrubbed."""
    raw = F.expr("concat('at /home/ann/x and /home/annex by ann for proj', doc_id % 3, ' key op://vault/k', doc_id, ' ', coalesce(text, ''))")
    scrubbed = texts.scrub_identity(raw, ["ann"], ["proj1"], ["the"])
    return read(spark, d, "documents").select("doc_id", F.length(scrubbed).cast("long").alias("chars"), F.sha2(scrubbed, 256).alias("scrubbed_sha256"))


@registered("""SELECT doc_id, term, i AS line FROM (SELECT doc_id, string_split(text || chr(10) || 'see op://vault/x' || chr(10) || 'op://v/y // pickaxe-allow', chr(10)) AS x FROM documents),
    LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i), (VALUES ('op://'), ('idiot'), ('License')) t(term)
    WHERE NOT regexp_matches(x[i], '//\\s*pickaxe-allow\\s*$') AND contains(x[i], term)""")
def leak_scan_lines(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.col("text"), F.lit("\nsee op://vault/x\nop://v/y // pickaxe-allow"))
    hits = read(spark, d, "documents").select("doc_id", F.explode(texts.leak_hits(body, ["idiot", "License"])).alias("h"))
    return hits.select("doc_id", "h.term", F.col("h.line").cast("long").alias("line"))


@registered("SELECT doc_id, CASE WHEN length(text) <= 2000 THEN text ELSE left(text, 1000) || chr(10) || chr(10) || '[...session truncated for context...]' || chr(10) || chr(10) || right(text, 1000) END AS document FROM documents")
def doc_truncate(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", texts.truncate_document(F.col("text"), 2000).alias("document"))


@registered("SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN text ELSE 'About ' || source || '.' || chr(10) || chr(10) || text END) AS text_sha256 FROM documents")
def cr_prefix_concat(spark: SparkSession, d: str) -> DataFrame:
    prefix = F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("About "), F.col("source"), F.lit("."))).otherwise("")
    return read(spark, d, "documents").select("doc_id", F.sha2(texts.with_prefix(prefix, F.col("text")), 256).alias("text_sha256"))


# --- analytics ---------------------------------------------------------------------------------------------

_ERROR = "'Exit code ' || event_id || ' at /srv/u' || user_id || '/x.py: \"' || event_type || '\" id deadbeefdeadbeef' || (event_id % 10) || CASE event_id % 3 WHEN 0 THEN ' permission denied' WHEN 1 THEN '  has not been   read ' ELSE '' END"
_SIGNED = f"""g AS (SELECT event_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_ERROR}, '"[^"]*"|''[^'']*''', '<STR>', 'g'),
    '(?i)\\b[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}\\b', '<ID>', 'g'), '(?i)\\b[0-9a-f]{{16,}}\\b', '<ID>', 'g'), '/[^\\s''"]+', '<PATH>', 'g'), '[0-9]+', '<NUM>', 'g'), '\\s+', ' ', 'g')) AS signature FROM events)"""
SEEDS = {"oversized-read": ["has not been read"], "denied": ["Permission denied", "forbidden"], "exit-nonzero": ["exit code 1"]}


def _signatures(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", "user_id", "ts", analytics.error_signature(F.expr(_ERROR)).alias("signature"))


@registered(f"WITH {_SIGNED} SELECT event_id, signature FROM g")
def error_signature(spark: SparkSession, d: str) -> DataFrame:
    return _signatures(spark, d).select("event_id", "signature")


@registered(f"""WITH {_SIGNED} SELECT CASE WHEN contains(lower(signature), 'has not been read') THEN 'oversized-read' WHEN contains(lower(signature), 'permission denied') OR contains(lower(signature), 'forbidden') THEN 'denied'
    WHEN contains(lower(signature), 'exit code 1') THEN 'exit-nonzero' ELSE 'UNMATCHED' END AS bucket, count(*) AS n FROM g GROUP BY 1""")
def error_bucket(spark: SparkSession, d: str) -> DataFrame:
    return _signatures(spark, d).groupBy(analytics.error_bucket(F.col("signature"), SEEDS).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@registered("""SELECT event_type, round(count(DISTINCT user_id)::DOUBLE / (SELECT count(DISTINCT user_id) FROM events) * 0.5 * (0.6 * exp(-date_diff('day', max(ts)::DATE, DATE '2024-02-15') / 30.0::DOUBLE)
    + 0.4 * least(1.0::DOUBLE, greatest(0.0::DOUBLE, count(*)::DOUBLE / 1000))), 9) AS score FROM events GROUP BY event_type""")
def fingerprint_score(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    total = e.agg(F.count_distinct("user_id").alias("total"))
    per = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("affected"), F.date_diff(F.lit("2024-02-15").cast("date"), F.max("ts").cast("date")).alias("days"), F.count(F.lit(1)).alias("n"))
    score = analytics.fingerprint_score(F.col("affected"), F.col("total"), F.lit(0.5), F.col("days"), F.col("n") / 1000.0)
    return per.crossJoin(F.broadcast(total)).select("event_type", F.round(score, 9).alias("score"))


_PATH = "CASE page_id % 5 WHEN 0 THEN '/home/me' WHEN 1 THEN '/tmp/' || page_id WHEN 2 THEN '/home/me/p' || page_id % 7 || '/.acme-worktrees/x' || page_id WHEN 3 THEN '/home/me/p' || page_id % 7 ELSE NULL END"


@registered(f"""SELECT project, count(*) AS n FROM (SELECT CASE WHEN p IS NULL OR p = '/home/me' OR p = '/tmp' OR starts_with(p, '/tmp/') THEN 'unscoped' ELSE regexp_replace(p, '/\\.[^/]+-worktrees/.*', '') END AS project FROM (SELECT {_PATH} AS p FROM pages)) GROUP BY project""")
def project_path(spark: SparkSession, d: str) -> DataFrame:
    p = analytics.canonical_project(F.expr(_PATH), "/home/me")
    return read(spark, d, "pages").groupBy(p.alias("project")).agg(F.count(F.lit(1)).alias("n"))


_LOG = "'start' || chr(10) || repeat('CR failed for x' || chr(10), (event_id % 4)::INT) || CASE WHEN event_id % 11 = 0 THEN '402 Insufficient Balance' ELSE '' END || 'Done: ' || event_id || ' inserted, ' || user_id || ' quarantined'"


@registered(f"""WITH l AS (SELECT event_id % 6 = 0 AS note, {_LOG} AS text, event_id, user_id, ts FROM events), m AS (SELECT * FROM l)
    SELECT count(*) FILTER (NOT note) AS sessions_ingested, count(*) FILTER (note) AS memory_refreshes, sum(event_id) FILTER (NOT note)::BIGINT AS chunks_inserted, sum(user_id) FILTER (NOT note)::BIGINT AS chunks_quarantined,
    sum(event_id % 4) FILTER (NOT note)::BIGINT AS cr_failures, max(event_id % 4) FILTER (NOT note)::BIGINT AS worst_run, max(ts) FILTER (NOT note AND (contains(text, '402') OR contains(text, 'Insufficient Balance'))) AS latest_unpaid FROM m""")
def ingest_health(spark: SparkSession, d: str) -> DataFrame:
    logs = read(spark, d, "events").select(F.when(F.col("event_id") % 6 == 0, "memory-refresh-1.log").otherwise("run.log").alias("name"), F.expr(_LOG).alias("text"), F.col("ts").alias("modified"))
    return files.log_health(logs)


# --- transcripts and exports -------------------------------------------------------------------------------

PRODUCT = "siltstone"


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as transcript lines: strings, blocks with a tool call, and the older envelope."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    tool = F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.when(F.col("turn_index") % 2 == 0, "Bash").otherwise("search_all").alias("name"), F.struct(F.col("text").alias("command")).alias("input"))
    said = F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("struct<command:string>").alias("input"))
    line = (
        F.when(F.col("role") == "user", F.to_json(F.struct(F.lit("user").alias("type"), message("user", F.col("text")).alias("message"))))
        .when(F.col("role") == "assistant", F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(F.lit("assistant").alias("role"), F.array(said, tool).alias("content")).alias("message"))))
        .otherwise(F.to_json(F.struct(F.lit("message").alias("type"), F.lit("id1").alias("id"), message("user", F.concat(F.lit("about Siltstone: "), F.col("text"))).alias("message"))))
    )
    return turns(spark, d).select("session_id", F.col("turn_index").alias("line_no"), line.alias("line"))


_ENTRY_TEXT = """CASE role WHEN 'user' THEN text WHEN 'assistant' THEN text || chr(10) || CASE WHEN turn % 2 = 0 THEN '[Bash: ' || left(text, 60) || ']' ELSE '[search_all]' END ELSE 'about Siltstone: ' || text END"""


@registered(f"""SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_index, CASE role WHEN 'assistant' THEN 'assistant' ELSE 'user' END AS role, sha256({_ENTRY_TEXT}) AS text_sha256,
    CASE WHEN role <> 'assistant' THEN '' WHEN turn % 2 = 0 THEN 'Bash' ELSE 'search_all' END AS tools, role = 'system' OR (role = 'assistant' AND turn % 2 = 1) AS is_meta_message FROM conversations""")
def transcript_projection(spark: SparkSession, d: str) -> DataFrame:
    t = transcripts.to_turns(transcripts.parse(_entries(spark, d)), PRODUCT)
    return t.select("session_id", F.col("turn_index").cast("long").alias("turn_index"), "role", F.sha2("text", 256).alias("text_sha256"), F.array_join("tools_called", ",").alias("tools"), "is_meta_message")


@registered("""SELECT conv_id AS session_id, count(*) FILTER (role = 'assistant' AND turn % 2 = 1) AS tool_calls, count(*) FILTER (role <> 'assistant') AS user_messages, count(*) FILTER (role = 'system') AS on_topic,
    count(*) FILTER (role = 'assistant' AND turn % 2 = 1) >= 3 AS is_meta, (count(*) FILTER (role = 'assistant' AND turn % 2 = 1) >= 3)
    OR (count(*) FILTER (role <> 'assistant') >= 5 AND count(*) FILTER (role = 'system') * 2 >= count(*) FILTER (role <> 'assistant')) AS is_meta_by_topic FROM conversations GROUP BY conv_id""")
def meta_flags(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.meta_sessions(transcripts.parse(_entries(spark, d)), PRODUCT)


_TOOLS = ["Read", "Edit", "Write", "Bash", "Task", "Grep", "Glob", "WebFetch", "WebSearch", "TodoWrite", "Other"]


def _one_liners(rows: DataFrame, keys: list[str]) -> DataFrame:
    """doc_id, line of calls of the tool-th tool with v as each argument.

    Each step is a step of the plan as well: v, the arguments and the line are used several times and made once.
    """
    called = rows.withColumn("name", F.element_at(F.array(*map(F.lit, _TOOLS)), F.col("tool").cast("int")))
    called = called.withColumn("args", F.to_json(F.struct(*[F.col("v").alias(k) for k in keys])))
    return called.select("doc_id", projection.one_liner(F.col("name"), F.col("args")).alias("line"))


@registered("""WITH t AS (SELECT doc_id, regexp_replace(text, '[^A-Za-z ]', '', 'g') AS v, doc_id % 11 AS k FROM documents)
    SELECT doc_id, sha256(CASE k WHEN 0 THEN '[Read: ' || v || ']' WHEN 1 THEN '[Edit: ' || v || ' (' || left(v, 40) || '...)]' WHEN 2 THEN '[Write: ' || v || ']' WHEN 3 THEN '[Bash: ' || left(v, 60) || ']'
    WHEN 4 THEN '[Task: "' || left(v, 50) || '" → general-purpose]' WHEN 5 THEN '[Grep: ?]' WHEN 6 THEN '[Glob: ?]' WHEN 7 THEN '[WebFetch: ' || left(v, 60) || ']' WHEN 8 THEN '[WebSearch: ' || v || ']' WHEN 9 THEN '[TodoWrite]' ELSE '[Other]' END) AS line_sha256 FROM t""")
def tool_one_liners(spark: SparkSession, d: str) -> DataFrame:
    """Arguments of all letters and spaces of the text; the operator's own lengths cut."""
    # Runs that stay are found several times faster than characters that go.
    v = F.array_join(F.regexp_extract_all("text", F.lit("[A-Za-z ]+"), F.lit(0)), "")
    rows = read(spark, d, "documents").select("doc_id", (F.col("doc_id") % 11 + 1).alias("tool"), v.alias("v"))
    return _one_liners(rows, ["file_path", "old_string", "command", "description", "url", "query"]).select("doc_id", F.sha2("line", 256).alias("line_sha256"))


@registered()
def tool_one_liners_whole(spark: SparkSession, d: str) -> DataFrame:
    """Arguments of the whole text as it stands, cut by the operator's own lengths only; no SQL: a test holds it against plain Python."""
    rows = read(spark, d, "documents").select("doc_id", (F.pmod("doc_id", F.lit(len(_TOOLS))) + 1).alias("tool"), F.coalesce("text", F.lit("")).alias("v"))
    lines = _one_liners(rows, ["file_path", "old_string", "command", "description", "pattern", "url", "query"])
    return lines.select("doc_id", F.length("line").cast("long").alias("chars"), F.sha2("line", 256).alias("line_sha256"))


@registered("""SELECT 'c' || conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_index, CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END AS role,
    sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS text_sha256, CASE WHEN turn % 2 = 0 THEN 't' || turn ELSE 'start' END AS occurred_at FROM conversations WHERE length(regexp_replace(text, '\\s', '', 'g')) > 0""")
def web_export(spark: SparkSession, d: str) -> DataFrame:
    m = F.struct(F.col("turn_index"), F.when(F.col("role") == "user", "human").otherwise("assistant").alias("sender"), F.concat(F.lit(" "), F.col("text"), F.lit("\n")).alias("text"), F.when(F.col("turn_index") % 2 == 0, F.concat(F.lit("t"), F.col("turn_index").cast("string"))).alias("created_at"))
    c = turns(spark, d).groupBy("session_id").agg(F.array_sort(F.collect_list(m)).alias("chat_messages"))
    json = F.to_json(F.array(F.struct(F.concat(F.lit("c"), F.col("session_id").cast("string")).alias("uuid"), F.lit("name").alias("name"), F.lit("start").alias("created_at"), "chat_messages")))
    return _export_rows(exports.web_chats(c.select(json.alias("json"))))


def _export_rows(rows: DataFrame) -> DataFrame:
    return rows.select("session_id", F.col("turn_index").cast("long").alias("turn_index"), "role", F.sha2("text", 256).alias("text_sha256"), "occurred_at")


@registered("""WITH RECURSIVE w AS (SELECT conv_id, turn, 0 AS depth FROM conversations QUALIFY turn = max(turn) OVER (PARTITION BY conv_id)
      UNION ALL SELECT c.conv_id, c.turn, depth + 1 FROM w JOIN conversations c ON c.conv_id = w.conv_id AND c.turn = w.turn - CASE WHEN w.turn % 5 = 4 THEN 2 ELSE 1 END)
    SELECT 'g' || c.conv_id AS session_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY depth DESC) - 1 AS turn_index, role, sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(10) || 'more') AS text_sha256,
    strftime(TIMESTAMP '2024-01-01' + to_seconds(turn::INT), '%Y-%m-%dT%H:%M:%S.000Z') AS occurred_at FROM w JOIN conversations c USING (conv_id, turn) WHERE role IN ('user', 'assistant')""")
def graph_linearize(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth turn follows the one before the last: branches are left out."""
    key = lambda c: c.cast("string")
    i = F.col("turn_index")
    node = F.struct(
        key(i).alias("id"), key(F.when(i % 5 == 4, i - 2).otherwise(i - 1)).alias("parent"),
        F.struct(F.struct("role").alias("author"), (1704067200 + i).cast("double").alias("create_time"), F.struct(F.array(F.regexp_replace("text", r"^\s+|\s+$", ""), F.lit("more")).alias("parts")).alias("content"),
                 F.struct(F.lit(False).alias("is_visually_hidden_from_conversation")).alias("metadata")).alias("message"))
    c = turns(spark, d).groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct(key(i), node))).alias("mapping"), key(F.max("turn_index")).alias("current_node"))
    json = F.to_json(F.array(F.struct(F.concat(F.lit("g"), key(F.col("session_id"))).alias("conversation_id"), F.lit("title").alias("title"), "current_node", "mapping")))
    return _export_rows(exports.graph_chats(c.select(json.alias("json"))))


@registered("""SELECT 'telegram-' || conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_index, CASE role WHEN 'assistant' THEN 'assistant' ELSE 'user' END AS role,
    sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g') || CASE WHEN turn % 2 = 1 THEN ' link' ELSE '' END) AS text_sha256, '2024-01-01' AS occurred_at FROM conversations WHERE role <> 'system'""")
def messenger_export(spark: SparkSession, d: str) -> DataFrame:
    """Odd turns are rich text: a string and an object with a text."""
    clean = F.regexp_replace("text", r"^\s+|\s+$", "")
    rich = F.concat(F.lit("["), F.to_json(F.array(clean)).substr(F.lit(2), F.length(F.to_json(F.array(clean))) - 2), F.lit(',{"type":"link","text":" link"}]'))
    body = F.when(F.col("turn_index") % 2 == 1, rich).otherwise(F.to_json(F.array(clean)).substr(F.lit(2), F.length(F.to_json(F.array(clean))) - 2))
    m = F.concat(F.lit('{"type":"'), F.when(F.col("role") == "system", "service").otherwise("message"), F.lit('","date":"2024-01-01","from":"'), F.when(F.col("role") == "assistant", "Chat").otherwise("Me"), F.lit('","text":'), body, F.lit("}"))
    c = turns(spark, d).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn_index", m.alias("m")))).alias("ms"))
    json = F.concat(F.lit('{"name":"Chat","id":'), F.col("session_id").cast("string"), F.lit(',"messages":['), F.array_join(F.transform("ms", lambda x: x["m"]), ","), F.lit("]}"))
    return _export_rows(exports.messenger_chats(c.select(json.alias("json"))))


# --- events: the streaming operators' batch twins -----------------------------------------------------------

@registered("SELECT time_bucket(INTERVAL 1 day, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    return streaming.tumbling(read(spark, d, "events"))


@registered("""WITH g AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 12 hours THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
    (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM g GROUP BY user_id, s""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    return streaming.user_sessions(read(spark, d, "events"))


@registered("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, len(embedding) = 64 AS valid FROM embeddings")
def vector_check(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", F.round(vector.norm(F.col("embedding")), 6).alias("norm"), vector.is_valid(F.col("embedding"), 64).alias("valid"))
