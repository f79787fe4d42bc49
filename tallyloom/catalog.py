"""Every query of the library by name, with its DuckDB SQL.

The corpus is ``documents``, asked by the deterministic digest answerer, so both
engines can compute every answer from ids. Gold comes from ``labels``, ``lang``
and ``n_chars``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import columns as C
from tallyloom.operators import chunking, compare, recipes, review, runs, sampling, scoring
from tallyloom.operators.answering import HashAnswerer
from tallyloom.plans import questions as Q
from tallyloom.sources import corpus

LANGS = ("en", "de", "es", "fr")
QS = Q.from_mapping(
    {
        "version": 1,
        "name": "corpus-audit",
        "defaults": {"gate": "strict", "projection": ["text"]},
        "questions": [
            {"id": "usable", "type": "noul", "instructions": "The text is fit for training.", "criteria": {"true": "Clean prose.", "false": "Junk."}},
            {"id": "harmful", "type": "noul", "instructions": "The text holds toxic content."},
            {"id": "language", "type": "choice", "instructions": "The language of the text.", "criteria": {x: f"Mostly {x}." for x in LANGS}},
            {"id": "length_band", "type": "score", "gate": "exploratory", "instructions": "The length of the text.", "criteria": ["Tiny.", "Short.", "Medium.", "Long."]},
        ],
    }
)
GROUP = Q.call_groups(QS)[0]
ANSWERER = HashAnswerer()
TWO = Q.from_mapping(
    {"version": 1, "name": "chat", "defaults": {"projection": ["text"]}, "questions": [{"id": "polite", "type": "noul", "instructions": "The turn is polite."}, {"id": "by_user", "type": "noul", "instructions": "The speaker is a user.", "projection": ["role", "text"]}]}
)


def docs_of(spark, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def cells(spark, d: str, salt: str = "") -> DataFrame:
    return runs.cells_of(docs_of(spark, d), QS, HashAnswerer(salt=salt))


def gold(spark, d: str) -> DataFrame:
    """(doc_id, question_id, gold_answer, stratum_weight): every eleventh labelled document is unclear."""
    lab = spark.read.parquet(f"{d}/labels.parquet")
    docs = docs_of(spark, d).select("doc_id", "lang", "n_chars")
    rows = lab.join(docs, "doc_id").select(
        F.col("doc_id"), F.explode(F.array(*(F.struct(F.lit(q).alias("question_id"), v.alias("gold_answer")) for q, v in (
            ("usable", F.when(F.col("quality") == 1, "true").otherwise("false")), ("harmful", F.when(F.col("toxic") == 1, "true").otherwise("false")), ("language", F.col("lang")),
            ("length_band", F.when(F.col("n_chars") < 500, "0").when(F.col("n_chars") < 1500, "1").when(F.col("n_chars") < 4000, "2").otherwise("3")))))).alias("g"),
    )
    return rows.select(F.col("doc_id").cast("string").alias("doc_id"), "g.question_id", F.when(F.col("doc_id") % 11 == 0, "unclear").otherwise(F.col("g.gold_answer")).alias("gold_answer"), (F.col("doc_id") % 3 + 1).cast("double").alias("stratum_weight"))


def joined(spark, d: str) -> DataFrame:
    return sampling.gold_join(gold(spark, d), cells(spark, d))


def hexed(what: str, doc: str = "doc_id") -> str:
    return f"CAST('0x' || substr(sha256(CAST({doc} AS VARCHAR) || '|{what}'), 1, 8) AS BIGINT)"


def noul_sql(q: str, doc: str = "doc_id") -> str:
    return f"CAST({hexed(q, doc)} % 101 AS DOUBLE) / CAST(100 AS DOUBLE)"


def weights_sql(q: str, salt: str = "") -> str:
    return "[" + ", ".join(f"CAST({hexed(f'{q}{salt}#{k}')} % 97 + 1 AS DOUBLE)" for k in range(4)) + "]"


def cells_sql(salt: str = "", name: str = "cells") -> str:
    """CTEs ending in ``cells(doc_id, question_id, type, noul, choice, score, p, confidence, modal, tv)``."""
    a = f"{name}_raw"
    nouls = " UNION ALL ".join(f"SELECT doc_id, '{q}' AS question_id, 'noul' AS type, {noul_sql(q + salt)} AS noul, CAST(NULL AS DOUBLE[]) AS w FROM documents" for q in ("usable", "harmful"))
    rest = " UNION ALL ".join(f"SELECT doc_id, '{q}', '{t}', NULL, {weights_sql(q, salt)} FROM documents" for q, t in (("language", "choice"), ("length_band", "score")))
    return f"""{a} AS ({nouls} UNION ALL {rest}),
{a}2 AS (SELECT doc_id, question_id, type, noul, CASE WHEN w IS NOT NULL THEN [w[1] / (w[1] + w[2] + w[3] + w[4]), w[2] / (w[1] + w[2] + w[3] + w[4]), w[3] / (w[1] + w[2] + w[3] + w[4]), w[4] / (w[1] + w[2] + w[3] + w[4])] END AS p FROM {a}),
{name} AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, question_id, type, noul, CASE WHEN type = 'choice' THEN ['en', 'de', 'es', 'fr'][list_position(p, list_max(p))] END AS choice,
  CASE WHEN type = 'score' THEN p[1] * 0 + p[2] * 1 + p[3] * 2 + p[4] * 3 END AS score, p, CASE WHEN type = 'noul' THEN abs(noul - CAST(0.5 AS DOUBLE)) * 2 ELSE list_max(p) END AS confidence,
  CASE WHEN type = 'score' THEN CAST(list_position(p, list_max(p)) - 1 AS VARCHAR) END AS modal, CASE WHEN type = 'noul' THEN abs(noul - CAST(0.5 AS DOUBLE)) ELSE list_max(p) END AS tv FROM {a}2)"""


GOLD_SQL = """gold AS (
  SELECT CAST(l.doc_id AS VARCHAR) AS doc_id, q.question_id, CASE WHEN l.doc_id % 11 = 0 THEN 'unclear' WHEN q.question_id = 'usable' THEN CASE WHEN quality = 1 THEN 'true' ELSE 'false' END
    WHEN q.question_id = 'harmful' THEN CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END WHEN q.question_id = 'language' THEN lang
    ELSE CASE WHEN n_chars < 500 THEN '0' WHEN n_chars < 1500 THEN '1' WHEN n_chars < 4000 THEN '2' ELSE '3' END END AS gold, CAST(l.doc_id % 3 + 1 AS DOUBLE) AS w
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id CROSS JOIN (VALUES ('usable'), ('harmful'), ('language'), ('length_band')) q(question_id)
), judged AS (
  SELECT g.*, c.type, c.noul, c.choice, c.modal, c.confidence, c.tv, g.gold = 'unclear' AS unclear,
    CASE WHEN g.gold = 'unclear' THEN NULL WHEN c.type = 'noul' THEN CASE WHEN (c.noul > 0.5) = (g.gold = 'true') THEN 1 ELSE 0 END WHEN c.type = 'choice' THEN CASE WHEN c.choice = g.gold THEN 1 ELSE 0 END ELSE CASE WHEN c.modal = g.gold THEN 1 ELSE 0 END END AS correct,
    CASE WHEN g.gold <> 'unclear' AND c.type = 'score' THEN CASE WHEN abs(TRY_CAST(c.modal AS INT) - TRY_CAST(g.gold AS INT)) <= 1 THEN 1 ELSE 0 END END AS near
  FROM gold g JOIN cells c USING (doc_id, question_id)
)"""
CELLS = "WITH " + cells_sql()
JUDGED = f"{CELLS}, {GOLD_SQL}"
ACC = """acc AS (SELECT question_id, any_value(type) AS type, count(*) FILTER (NOT unclear) AS n, count(*) FILTER (unclear) AS n_unclear, sum(w) FILTER (NOT unclear) AS sw, sum(w * w) FILTER (NOT unclear) AS sw2, sum(w * correct) AS swr, avg(correct) AS unweighted, sum(w * near) AS swn FROM judged GROUP BY question_id),
acc2 AS (SELECT question_id, type, n, n_unclear, sw * sw / sw2 AS n_eff, swr / sw AS accuracy, unweighted, swn / sw AS adjacent FROM acc)"""
Z, Z2 = C.Z95, C.Z95 * C.Z95
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, *cols: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


# --- answers -----------------------------------------------------------------------------------------------------


@query(f"{CELLS} SELECT doc_id, question_id, round(noul, 9) AS noul, round(confidence, 9) AS confidence FROM cells WHERE type = 'noul'")
def cells_noul(spark, d):
    return rounded(cells(spark, d).filter("type = 'noul'").select("doc_id", "question_id", "noul", "confidence"), "noul", "confidence")


@query(f"{CELLS} SELECT doc_id, choice, ['en', 'de', 'es', 'fr'][k] AS option, round(p[k], 9) AS p, round(confidence, 9) AS confidence FROM cells, range(1, 5) r(k) WHERE type = 'choice'")
def cells_choice(spark, d):
    c = cells(spark, d).filter("type = 'choice'").select("doc_id", "choice", F.explode("probabilities").alias("option", "p"), "confidence")
    return rounded(c, "p", "confidence")


@query(f"{CELLS} SELECT doc_id, round(score, 9) AS score, CAST(k - 1 AS VARCHAR) AS level, round(p[k], 9) AS p, ['Tiny.', 'Short.', 'Medium.', 'Long.'][k] AS legend FROM cells, range(1, 5) r(k) WHERE type = 'score'")
def cells_score(spark, d):
    c = cells(spark, d).filter("type = 'score'").select("doc_id", "score", "legend", F.explode("probabilities").alias("level", "p"))
    return rounded(c.select("doc_id", "score", "level", "p", F.element_at("legend", F.col("level")).alias("legend")), "score", "p")


@query(f"{CELLS} SELECT doc_id, modal AS modal_level FROM cells WHERE type = 'score'")
def modal_level(spark, d):
    return cells(spark, d).filter("type = 'score'").select("doc_id", C.modal_level(F.col("probabilities")).alias("modal_level"))


@query(f"SELECT CAST(page_id AS VARCHAR) AS doc_id, round({noul_sql('usable', 'page_id')}, 9) AS noul, CAST(ceil(length(html) / 4.0) AS BIGINT) AS tokens FROM pages")
def page_questions(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    a = ANSWERER.answer(F.col("page_id"), F.struct("html"), QS["usable"])
    return rounded(pages.select(F.col("page_id").cast("string").alias("doc_id"), a["noul"].alias("noul"), C.text_tokens(F.col("html")).alias("tokens")), "noul")


# --- planning ----------------------------------------------------------------------------------------------------

STATE_SQL = """CAST(ceil((length(replace(replace(replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')) + 11 + 1) / 4.0) AS BIGINT)"""


@query(f"SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS text_tokens, {STATE_SQL} AS state_tokens FROM documents")
def state_tokens(spark, d):
    return docs_of(spark, d).select("doc_id", C.text_tokens(F.col("text")).alias("text_tokens"), C.state_tokens(("text",)).alias("state_tokens"))


@query(f"WITH t AS (SELECT {STATE_SQL} AS s FROM documents) SELECT count(*) AS n_docs, round(avg(s), 6) AS state_tokens, CAST({GROUP.schema_tokens} AS BIGINT) AS schema_tokens, CAST(round_even((avg(s) + {GROUP.schema_tokens}) * count(*), 0) AS BIGINT) AS tokens FROM t")
def schema_estimate(spark, d):
    s = docs_of(spark, d).select(C.state_tokens(("text",)).alias("s")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("s").alias("a"))
    return s.select("n_docs", F.round("a", 6).alias("state_tokens"), F.lit(GROUP.schema_tokens).cast("bigint").alias("schema_tokens"), F.bround((F.col("a") + GROUP.schema_tokens) * F.col("n_docs")).cast("bigint").alias("tokens"))


@query("SELECT doc_id, CAST(ceil(CAST(ceil(length(text) / 4.0) AS BIGINT) * CAST(0.042 AS DOUBLE)) AS BIGINT) AS micro_usd FROM documents")
def cost_micro_usd(spark, d):
    return docs_of(spark, d).select("doc_id", C.micro_usd(C.text_tokens(F.col("text"))).alias("micro_usd"))


@query(f"SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS doc_id, '{Q.projection_id(['text'])}' AS projection_id, 'polite' AS question_id, CAST(1 AS BIGINT) AS n_fields FROM conversations UNION ALL SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR), '{Q.projection_id(['role', 'text'])}', 'by_user', 2 FROM conversations")
def two_group_projection(spark, d):
    conv = spark.read.parquet(f"{d}/conversations.parquet")
    doc_id = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    parts = [conv.select(doc_id.alias("doc_id"), F.lit(g.projection_id).alias("projection_id"), F.explode(F.array(*(F.lit(q.id) for q in g.questions))).alias("question_id"), F.lit(len(g.fields)).cast("bigint").alias("n_fields")) for g in Q.call_groups(TWO)]
    return parts[0].unionByName(parts[1])


def batches_sql(limit: int) -> str:
    """The greedy filling as one step for each question: the batch it is in, and what that holds with it."""
    steps = [f"s0 AS (SELECT doc_id, {STATE_SQL} AS s, -1 AS k, 0 AS used FROM documents)"]
    for n, q in enumerate(GROUP.questions):
        fresh = f"k < 0 OR used + {q.schema_tokens} > {limit}"
        steps.append(f"s{n + 1} AS (SELECT doc_id, s, CASE WHEN {fresh} THEN k + 1 ELSE k END AS k, CASE WHEN {fresh} THEN s ELSE used END + {q.schema_tokens} AS used FROM s{n})")
    n, fits = len(GROUP.questions), f"s + {max(q.schema_tokens for q in GROUP.questions)} <= {limit}"
    return f"WITH {', '.join(steps)} SELECT doc_id, CAST(CASE WHEN {fits} THEN {n} ELSE 0 END AS INT) AS n_questions, CAST(CASE WHEN {fits} THEN k + 1 ELSE 0 END AS INT) AS n_batches FROM s{n}"


@query(batches_sql(int(400 * 0.85)))
def split_batches(spark, d):
    """Batches of every document's questions under a limit of 400 tokens; none where the state fits no call."""
    docs = docs_of(spark, d)
    return docs.select("doc_id", C.context_batches(GROUP, C.state_tokens(("text",)), 400).alias("batches")).select("doc_id", F.coalesce(F.size("batches"), F.lit(0)).alias("n_questions"), F.coalesce(F.array_max("batches") + 1, F.lit(0)).alias("n_batches"))


@query("SELECT * FROM (VALUES ('added', 'd'), ('removed', 'a'), ('changed', 'b')) t(change, question_id)")
def questionset_diff(spark, d):
    got = Q.diff({"a": "1", "b": "2", "c": "3"}, {"b": "9", "c": "3", "d": "4"})
    return spark.createDataFrame([(k, q) for k in ("added", "removed", "changed") for q in getattr(got, k)], "change string, question_id string")


# --- corpus ------------------------------------------------------------------------------------------------------


def _by_text(spark, d):
    docs = docs_of(spark, d).select(F.sha2("text", 256).alias("hash"), F.col("doc_id").alias("row"))
    return corpus.normalize(docs, "hash", ["row"])


@query("SELECT sha256(text) AS doc_id, min(doc_id) AS first_row FROM documents WHERE text IS NOT NULL GROUP BY text")
def normalize_dedup(spark, d):
    return _by_text(spark, d)[0].select("doc_id", F.col("row").alias("first_row"))


@query("SELECT doc_id AS \"row\", 'duplicate id' AS reason FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k > 1")
def quarantine_rows(spark, d):
    return _by_text(spark, d)[1].select(F.get_json_object("raw", "$.row").cast("bigint").alias("row"), "reason")


@query("SELECT doc_id FROM documents WHERE doc_id % 4 <> 0")
def resume_remaining(spark, d):
    docs = docs_of(spark, d)
    return runs.remaining(docs, docs.filter("doc_id % 4 = 0")).select("doc_id")


CHUNK_SQL = """SELECT doc_id, CAST(k AS INT) AS chunk_index, substr(text, k * 900 + 1, 1000) AS chunk, length(text) AS n FROM documents, range(0, 200) r(k) WHERE k <= greatest(CAST(ceil((length(text) - 1000) / 900.0) AS INT), 0)"""
MANY_SQL = CHUNK_SQL.replace("range(0, 200)", "range(0, 2000)")


@query(f"SELECT doc_id, chunk_index, length(chunk) AS n_chars, md5(chunk) AS digest FROM ({MANY_SQL})")
def chunk_rows(spark, d):
    c = docs_of(spark, d).select("doc_id", F.explode(chunking.fixed_chunks(F.col("text"), 1000, 900)).alias("c"))
    return c.select("doc_id", "c.chunk_index", F.length("c.chunk").cast("bigint").alias("n_chars"), F.md5("c.chunk").alias("digest"))


@query(f"SELECT doc_id, count(*) AS n_chunks, max(chunk_index * 900 + length(chunk)) = any_value(n) AS covered FROM ({MANY_SQL}) GROUP BY doc_id")
def chunk_coverage(spark, d):
    c = docs_of(spark, d).select("doc_id", F.length("text").alias("n"), F.explode(chunking.fixed_chunks(F.col("text"), 1000, 900)).alias("c"))
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), (F.max(F.col("c.start") + F.length("c.chunk")) == F.first("n")).alias("covered"))


@query()
def chunk_states(spark, d):
    """Chunks of states by the exact splitter under a limit of 700 tokens (JSON escapes make its steps sequential)."""
    s = docs_of(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").alias("row_index"), C.state_json(("text",)).alias("state"), C.state_tokens(("text",)).alias("tokens"))
    return chunking.chunked(s, GROUP, 700).select("doc_id", "chunk_index", "chunk_count", F.length("state").alias("n_chars"), "error")


def _chunk_answers(spark, d):
    """Three answers for each document, as if it had three chunks."""
    parts = [cells(spark, d, salt=f"/{k}") for k in range(3)]
    return chunking.aggregate_chunks(parts[0].unionByName(parts[1]).unionByName(parts[2]))


THREE = "WITH " + ", ".join(cells_sql(f"/{k}", f"c{k}") for k in range(3)) + ", c AS (SELECT * FROM c0 UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM c2)"


@query(f"{THREE} SELECT doc_id, question_id, CAST(count(*) AS INT) AS chunk_count, round(max(noul), 9) AS noul, round(abs(max(noul) - 0.5) * 2, 9) AS confidence FROM c WHERE type = 'noul' GROUP BY doc_id, question_id")
def chunk_agg_noul(spark, d):
    return rounded(_chunk_answers(spark, d).filter("type = 'noul'").select("doc_id", "question_id", "chunk_count", "noul", "confidence"), "noul", "confidence")


@query(f"{THREE}, m AS (SELECT doc_id, ['en', 'de', 'es', 'fr'][k] AS o, sum(p[k]) / 3 AS p FROM c, range(1, 5) r(k) WHERE type = 'choice' GROUP BY doc_id, k), s AS (SELECT doc_id, o, p, row_number() OVER (PARTITION BY doc_id ORDER BY round(p, 12) DESC, o) AS r FROM m) SELECT doc_id, o AS choice, round(p, 9) AS confidence FROM s WHERE r = 1")
def chunk_agg_choice(spark, d):
    return rounded(_chunk_answers(spark, d).filter("type = 'choice'").select("doc_id", "choice", "confidence"), "confidence")


@query(f"{THREE} SELECT doc_id, round(avg(score), 9) AS score, round(sum(p[1]) / 3, 9) AS p0 FROM c WHERE type = 'score' GROUP BY doc_id")
def chunk_agg_score(spark, d):
    return rounded(_chunk_answers(spark, d).filter("type = 'score'").select("doc_id", "score", F.element_at("probabilities", "0").alias("p0")), "score", "p0")


# --- runs --------------------------------------------------------------------------------------------------------


def _looked_up(spark, d, keep: str):
    """All cells by ``hit``, where the cache has those that ``keep`` chooses."""
    c = cells(spark, d)
    key = runs.cache_key(F.col("doc_id"), F.col("question_id"), F.col("question_body_hash"), F.col("model"))
    wanted = c.select("doc_id", "question_id", key.alias("cache_key"))
    return runs.with_hits(wanted, wanted.filter(keep))


@query("WITH q(question_id) AS (VALUES ('usable'), ('harmful'), ('language'), ('length_band')) SELECT question_id, count(*) FILTER (doc_id % 3 = 0) AS hits, count(*) FILTER (doc_id % 3 <> 0) AS misses FROM documents, q GROUP BY question_id")
def cache_hits_misses(spark, d):
    got = _looked_up(spark, d, "cast(doc_id as bigint) % 3 = 0")
    return got.groupBy("question_id").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'length_band' AS question_id FROM documents")
def add_question_delta(spark, d):
    """What a run asks after a question is added to a finished one: that question alone."""
    return _looked_up(spark, d, "question_id <> 'length_band'").filter("not hit").select("doc_id", "question_id")


BUDGET_USD = 0.002
CALLS_SQL = f"SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) + {GROUP.schema_tokens} AS estimated, CAST(ceil(length(text) / 4.0) AS BIGINT) + 50 AS actual FROM documents"


@query(
    f"WITH c AS ({CALLS_SQL}), s AS (SELECT *, coalesce(sum(actual) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c), "
    f"b AS (SELECT min(doc_id) AS stop FROM s WHERE ceil(before * CAST(0.042 AS DOUBLE)) + ceil(estimated * CAST(0.042 AS DOUBLE)) > {Q.usd_to_micro_usd(BUDGET_USD)}) SELECT doc_id, CAST(before AS BIGINT) AS spent_before FROM s, b WHERE stop IS NULL OR doc_id < stop"
)
def budget_admission(spark, d):
    text = C.text_tokens(F.col("text"))
    calls = docs_of(spark, d).select(F.col("doc_id").alias("row_index"), (text + GROUP.schema_tokens).cast("bigint").alias("estimated"), (text + 50).cast("bigint").alias("actual"))
    return runs.admitted(calls, BUDGET_USD).select(F.col("row_index").alias("doc_id"), F.col("spent_before").cast("bigint").alias("spent_before"))


@query(f"SELECT round(CAST(sum(actual) AS DOUBLE) / sum(estimated), 9) AS ratio FROM ({CALLS_SQL})")
def calibration_ratio(spark, d):
    text = C.text_tokens(F.col("text"))
    return docs_of(spark, d).agg(F.round(F.sum(text + 50).cast("double") / F.sum(text + GROUP.schema_tokens), 9).alias("ratio"))


@query("SELECT count(*) AS calls, count(*) * 4 AS cells, CAST(count(*) * 130 AS BIGINT) AS tokens_charged, CAST(ceil(count(*) * 130 * CAST(0.042 AS DOUBLE)) AS BIGINT) AS micro_usd FROM documents")
def run_counters(spark, d):
    """Spend counts calls, not cells."""
    per = cells(spark, d).groupBy("call_id").agg(F.first("input_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    a = per.agg(F.count(F.lit(1)).alias("calls"), F.sum("n").alias("cells"), F.sum("t").alias("tokens_charged"))
    return a.select("calls", "cells", "tokens_charged", C.micro_usd(F.col("tokens_charged")).alias("micro_usd"))


# --- sampling ----------------------------------------------------------------------------------------------------


def _bin_sql(v: str) -> str:
    k = f"least(trunc({v} / CAST(0.2 AS DOUBLE)), 4)"
    return f"printf('%.1f-%.1f', {k} * CAST(0.2 AS DOUBLE), ({k} + 1) * CAST(0.2 AS DOUBLE))"


STRATA = f"{CELLS}, st AS (SELECT *, CASE type WHEN 'noul' THEN {_bin_sql('noul')} WHEN 'choice' THEN choice || ':' || {_bin_sql('confidence')} ELSE modal || ':' || {_bin_sql('confidence')} END AS stratum FROM cells)"


@query(f"{STRATA} SELECT question_id, stratum, count(*) AS n FROM st GROUP BY question_id, stratum")
def strata_counts(spark, d):
    return sampling.with_strata(cells(spark, d)).groupBy("question_id", "stratum").agg(F.count(F.lit(1)).alias("n"))


def _sample(spark, d):
    return sampling.stratified_sample(cells(spark, d).filter("question_id = 'usable'"), 40)


@query(f"{STRATA}, r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('0|' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY stratum) AS pool FROM st WHERE question_id = 'usable') SELECT doc_id, stratum, round(pool / 8.0, 9) AS stratum_weight FROM r WHERE k <= 8")
def strata_sample(spark, d):
    return rounded(_sample(spark, d).select("doc_id", "stratum", "stratum_weight"), "stratum_weight")


@query("SELECT * FROM (VALUES ('a', 3), ('b', 9), ('c', 8)) t(stratum, taken)")
def strata_allocation(spark, d):
    return spark.createDataFrame(list(sampling.allocate({"a": 3, "b": 100, "c": 100}, 20).items()), "stratum string, taken int")


@query("SELECT CAST(round(count(*), 6) AS DOUBLE) AS total FROM documents")
def weight_reconstruction(spark, d):
    return _sample(spark, d).agg(F.round(F.sum("stratum_weight"), 6).alias("total"))


@query("SELECT doc_id FROM documents ORDER BY sha256('7|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 50")
def reservoir_k(spark, d):
    return sampling.random_rows(docs_of(spark, d).select("doc_id"), 50, 7)


@query(f"{JUDGED} SELECT doc_id, question_id, gold AS gold_answer, w AS weight, type FROM judged")
def gold_join(spark, d):
    return joined(spark, d).select("doc_id", "question_id", "gold_answer", "weight", "type")


@query("SELECT 'x' || CAST(doc_id AS VARCHAR) AS doc_id FROM labels WHERE doc_id % 10 = 3")
def gold_unknown_ids(spark, d):
    g = gold(spark, d).filter("question_id = 'usable'")
    odd = g.withColumn("doc_id", F.when(F.col("doc_id").cast("bigint") % 10 == 3, F.concat(F.lit("x"), "doc_id")).otherwise(F.col("doc_id")))
    return sampling.unknown_gold(odd, cells(spark, d)).select("doc_id")


@query("SELECT CAST(l.doc_id AS VARCHAR) AS doc_id, 'maybe' AS gold_answer FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.doc_id % 7 = 2 AND l.doc_id % 11 <> 0")
def gold_bad_values(spark, d):
    g = gold(spark, d).filter("question_id = 'usable'")
    odd = g.withColumn("gold_answer", F.when((F.col("doc_id").cast("bigint") % 7 == 2) & (F.col("gold_answer") != "unclear"), "maybe").otherwise(F.col("gold_answer")))
    options = spark.createDataFrame([(q.id, q.options) for q in QS.questions], "question_id string, options array<string>")
    return sampling.bad_gold(sampling.gold_join(odd, cells(spark, d)), options).select("doc_id", "gold_answer")


# --- scoring -----------------------------------------------------------------------------------------------------


@query(f"{JUDGED}, {ACC} SELECT question_id, n, n_unclear, round(n_eff, 9) AS n_eff, round(accuracy, 9) AS accuracy, round(unweighted, 9) AS unweighted FROM acc2")
def weighted_accuracy(spark, d):
    return rounded(scoring.accuracy(joined(spark, d)).select("question_id", "n", "n_unclear", "n_eff", "accuracy", "unweighted"), "n_eff", "accuracy", "unweighted")


WILSON = f"(accuracy + {Z2} / (2 * n_eff)) / (1 + {Z2} / n_eff) {{}} CAST({Z} AS DOUBLE) * sqrt(accuracy * (1 - accuracy) / n_eff + {Z2} / (4 * n_eff * n_eff)) / (1 + {Z2} / n_eff)"


@query(f"{JUDGED}, {ACC} SELECT question_id, round(greatest({WILSON.format('-')}, 0), 9) AS lo, round(least({WILSON.format('+')}, 1), 9) AS hi FROM acc2")
def wilson_interval(spark, d):
    return rounded(scoring.accuracy(joined(spark, d)).select("question_id", "lo", "hi"), "lo", "hi")


@query(f"{JUDGED}, {ACC} SELECT question_id, round(adjacent, 9) AS adjacent FROM acc2 WHERE type = 'score'")
def adjacent_agreement(spark, d):
    return rounded(scoring.accuracy(joined(spark, d)).filter("type = 'score'").select("question_id", "adjacent"), "adjacent")


@query(f"{JUDGED} SELECT question_id, count(*) FILTER (unclear) AS n_unclear FROM judged GROUP BY question_id")
def unclear_counts(spark, d):
    return scoring.accuracy(joined(spark, d)).select("question_id", "n_unclear")


def _bins_sql(probability: bool) -> str:
    v, t, where = ("noul", "CASE WHEN gold = 'true' THEN 1 ELSE 0 END", "type = 'noul'") if probability else ("confidence", "correct", "type <> 'noul'")
    return f"{JUDGED}, bins AS (SELECT question_id, CAST(greatest(least(trunc({v} * 10), 9), 0) AS INT) AS bin, count(*) AS n, sum(w) AS weighted_n, sum(w * {v}) / sum(w) AS mean_value, sum(w * {t}) / sum(w) AS weighted_target FROM judged WHERE NOT unclear AND {where} GROUP BY 1, 2)"


ECE_SQL = " SELECT question_id, round(sum(weighted_n * abs(weighted_target - mean_value)) / sum(weighted_n), 9) AS ece FROM bins GROUP BY question_id"


@query(_bins_sql(False) + ECE_SQL)
def ece_confidence(spark, d):
    return rounded(scoring.calibration_error(joined(spark, d)), "ece")


@query(_bins_sql(True) + ECE_SQL)
def ece_probability(spark, d):
    return rounded(scoring.calibration_error(joined(spark, d), True), "ece")


@query(_bins_sql(False) + " SELECT question_id, bin, n, weighted_n, round(mean_value, 9) AS mean_value, round(weighted_target, 9) AS weighted_target FROM bins")
def reliability_bins(spark, d):
    b = scoring.reliability(joined(spark, d)).select("question_id", "bin", "n", "weighted_n", "mean_value", "weighted_target")
    return rounded(b, "mean_value", "weighted_target")


THRESHOLD = """, v AS (SELECT question_id, tv, sum(w) AS w, sum(w * w) AS w2, sum(w * correct) AS wc FROM judged WHERE NOT unclear GROUP BY 1, 2),
s AS (SELECT question_id, tv, sum(w) OVER o AS sw, sum(w2) OVER o AS sw2, sum(wc) OVER o AS swc, sum(w) OVER (PARTITION BY question_id) AS tw FROM v WINDOW o AS (PARTITION BY question_id ORDER BY tv DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT question_id, min(tv) FILTER (sw * sw / sw2 >= 30 AND swc / sw >= 0.5) AS threshold FROM s GROUP BY question_id)"""


@query(f"{JUDGED}{THRESHOLD} SELECT t.question_id, round(threshold, 9) AS threshold, round(sw / tw, 9) AS coverage FROM t LEFT JOIN s ON s.question_id = t.question_id AND s.tv = t.threshold")
def threshold_search(spark, d):
    return rounded(scoring.thresholds(joined(spark, d), target=0.5), "threshold", "coverage")


GATES = [(q.id, QS.gate(q)) for q in QS.questions]


@query(f"{JUDGED}, {ACC} SELECT question_id, CASE WHEN n < 30 OR accuracy IS NULL THEN 'INSUFFICIENT' WHEN accuracy >= 0.9 THEN 'PASS' WHEN question_id = 'length_band' THEN 'FAIL — exploratory only' ELSE 'FAIL' END AS verdict FROM acc2")
def verdicts(spark, d):
    gates = spark.createDataFrame(GATES, "question_id string, gate string")
    return scoring.verdicts(scoring.accuracy(joined(spark, d)), gates).select("question_id", "verdict")


@query(f"{JUDGED}, {ACC} SELECT bool_or(n >= 30 AND accuracy < 0.9 AND question_id <> 'length_band') AS failed FROM acc2")
def strict_failures(spark, d):
    gates = spark.createDataFrame(GATES, "question_id string, gate string")
    return scoring.strict_failure(scoring.verdicts(scoring.accuracy(joined(spark, d)), gates))


# --- review ------------------------------------------------------------------------------------------------------


def _limits(spark):
    return spark.createDataFrame([("usable", 0.2), ("language", 0.4), ("harmful", None)], "question_id string, threshold double")


@query(f"{CELLS} SELECT doc_id, question_id, round(confidence, 9) AS confidence FROM cells WHERE (question_id = 'usable' AND tv < CAST(0.2 AS DOUBLE)) OR (question_id = 'language' AND tv < CAST(0.4 AS DOUBLE))")
def review_queue(spark, d):
    return rounded(review.review_queue(cells(spark, d), _limits(spark)).select("doc_id", "question_id", "confidence"), "confidence")


def _overrides(spark, d):
    docs = docs_of(spark, d).filter("doc_id % 5 = 0").select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    return docs.select("doc_id", F.lit("language").alias("question_id"), F.when(F.col("k") == 1, "en").otherwise("fr").alias("human_answer"), F.lit("r").alias("reviewer"), F.timestamp_seconds("k").alias("ts"), F.lit("run").alias("source_run_id"))


@query(f"{CELLS} SELECT c.doc_id, c.choice, o.h AS human_answer, coalesce(o.h, c.choice) AS value FROM cells c LEFT JOIN (SELECT CAST(doc_id AS VARCHAR) AS doc_id, h FROM documents, (VALUES ('en'), ('fr')) t(h) WHERE doc_id % 5 = 0) o USING (doc_id) WHERE c.question_id = 'language'")
def overrides_merged(spark, d):
    return review.merged(cells(spark, d).filter("question_id = 'language'"), _overrides(spark, d)).select("doc_id", "choice", "human_answer", "value")


@query(f"{CELLS} SELECT c.doc_id, CASE WHEN CAST(c.doc_id AS BIGINT) % 5 = 0 THEN 'fr' ELSE c.choice END AS value FROM cells c WHERE c.question_id = 'language'")
def overrides_latest(spark, d):
    return review.merged(cells(spark, d).filter("question_id = 'language'"), _overrides(spark, d), True).select("doc_id", "value")


# --- comparison --------------------------------------------------------------------------------------------------

TUNE = "WITH " + cells_sql() + ", " + cells_sql("/b", "var")
PAIRS = (
    "SELECT question_id, type, count(*) AS n, avg(CASE WHEN CASE type WHEN 'noul' THEN (r.noul > 0.5) = (v.noul > 0.5) WHEN 'choice' THEN r.choice = v.choice ELSE r.modal = v.modal END THEN CAST(1 AS DOUBLE) ELSE 0 END) AS agreement, "
    "avg(CASE type WHEN 'noul' THEN abs(r.noul - v.noul) WHEN 'choice' THEN abs(list_max(r.p) - v.p[list_position(r.p, list_max(r.p))]) ELSE abs(r.score - v.score) END) AS drift FROM cells r JOIN var v USING (doc_id, question_id, type) GROUP BY 1, 2"
)


def _agreed(spark, d):
    return compare.agreement(cells(spark, d), cells(spark, d, "/b"))


def _tune(kind: str):
    sql = f"{TUNE}, a AS ({PAIRS}) SELECT question_id, n, round(agreement, 9) AS agreement, round(drift, 9) AS drift FROM a WHERE type = '{kind}'"

    def tune(spark, d):
        return rounded(_agreed(spark, d).filter(F.col("type") == kind).select("question_id", "n", "agreement", "drift"), "agreement", "drift")

    tune.__name__ = f"tune_{kind}"
    query(sql)(tune)


for _kind in Q.KINDS:
    _tune(_kind)


@query(f"{TUNE}, a AS ({PAIRS}) SELECT question_id, CASE type WHEN 'noul' THEN agreement >= 0.97 AND drift <= 0.05 WHEN 'choice' THEN agreement >= 0.95 ELSE agreement >= 0.92 AND drift <= 0.15 END AS passed FROM a")
def tune_verdict(spark, d):
    return compare.with_floors(_agreed(spark, d)).select("question_id", "passed")


ABLATE = "WITH " + cells_sql() + ", " + GOLD_SQL + ", " + ACC + ", " + cells_sql("/full", "wide") + ", " + GOLD_SQL.replace("judged AS", "judged_w AS").replace("gold AS", "gold_w AS", 1).replace("FROM gold g JOIN cells c", "FROM gold_w g JOIN wide c") + ", " + ACC.replace("acc2 AS", "accw2 AS").replace("acc AS", "accw AS").replace("FROM judged ", "FROM judged_w ").replace("FROM acc)", "FROM accw)")


@query(f"{ABLATE} SELECT question_id, round(a.accuracy, 9) AS projected, round(b.accuracy, 9) AS full_record, CASE WHEN a.accuracy > b.accuracy THEN 'projected' WHEN a.accuracy < b.accuracy THEN 'full-record' ELSE 'tie' END AS winner FROM acc2 a JOIN accw2 b USING (question_id)")
def ablation_compare(spark, d):
    g = gold(spark, d)
    a, b = (scoring.accuracy(sampling.gold_join(g, cells(spark, d, s))) for s in ("", "/full"))
    return rounded(compare.ablation(a, b), "projected", "full_record")


# --- recipes -----------------------------------------------------------------------------------------------------


@query(f"{CELLS} SELECT doc_id, max(round(noul, 9)) FILTER (question_id = 'usable') AS usable, max(round(noul, 9)) FILTER (question_id = 'harmful') AS harmful, max(choice) AS language, max(modal) AS length_band FROM cells GROUP BY doc_id")
def pivot_wide(spark, d):
    value = F.coalesce(F.round("noul", 9).cast("string"), "choice", F.when(F.col("type") == "score", C.modal_level(F.col("probabilities"))))
    wide = recipes.pivot_wide(cells(spark, d), [q.id for q in QS.questions], value)
    return wide.withColumns({c: F.col(c).cast("double") for c in ("usable", "harmful")})


@query(f"{CELLS} SELECT question_id, count(*) FILTER (tv > CAST(0.4 AS DOUBLE)) AS n_confident, count(*) AS n FROM cells GROUP BY question_id")
def threshold_counts(spark, d):
    return recipes.threshold_counts(cells(spark, d), 0.4)


@query(
    f"WITH c AS (SELECT date_trunc('week', ts) AS week, abs({noul_sql('usable', 'event_id')} - CAST(0.5 AS DOUBLE)) AS tv FROM events), w AS (SELECT week, count(*) AS total, count(*) FILTER (tv > CAST(0.3 AS DOUBLE)) AS confident FROM c GROUP BY week) "
    "SELECT strftime(week, '%Y-%m-%d') AS week, total, confident, CAST(sum(total) OVER (ORDER BY week) AS BIGINT) AS running, round(sum(total) OVER (ORDER BY week) / sum(total) OVER (), 9) AS share FROM w"
)
def weekly_coverage(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    one = Q.from_mapping({"version": 1, "name": "events", "questions": [{"id": "usable", "type": "noul", "instructions": "The event is useful.", "projection": ["event_type", "props"]}]})
    c = runs.cells_of(events.withColumn("doc_id", F.col("event_id")), one, ANSWERER)
    out = recipes.weekly_coverage(c, events, "event_id", "ts", 0.3)
    return rounded(out.withColumn("week", F.date_format("week", "yyyy-MM-dd")), "share")


@query(f"{CELLS} SELECT doc_id, round(tv, 9) AS tv FROM cells WHERE question_id = 'usable' ORDER BY cells.tv, doc_id LIMIT 10")
def topk_uncertain(spark, d):
    return rounded(recipes.most_uncertain(cells(spark, d), "usable", 10), "tv")
