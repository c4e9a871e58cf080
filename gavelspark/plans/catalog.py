"""The queries of the core operators, each beside equal DuckDB SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gavelspark.functions import prompts as P
from gavelspark.functions import rewards as R
from gavelspark.functions import text as X
from gavelspark.operators import calibration as C
from gavelspark.operators import ranking as K
from gavelspark.operators import selection as S
from gavelspark.operators import votes as V
from gavelspark.session import materialize, shared_dir, ship_package
from gavelspark.sources import readers, sinks
from gavelspark.sources.fixtures import PRELUDE, SAME, Frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_col = F.col


def query(sql: str | None = None, name: str | None = None):
    """Register a function of ``Frames`` under its name; ``sql`` sees the derived inputs as tables."""

    def register(f: Callable[[Frames], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(Frames(spark, sf_dir))

        key = name or f.__name__
        QUERIES[key] = run
        if sql:
            SQL[key] = PRELUDE + sql
        return f

    return register


# Sources


@query("SELECT list_id, source, num_candidates FROM evaluate WHERE split = 'heldout'")
def scan_dataset_hub(f):
    return readers.scan_split(f.spark, f.sf_dir, "evaluate", "heldout").select("list_id", "source", "num_candidates")


@query("SELECT pair_id, list_id, source, CAST(length(prompt) AS INT) AS prompt_chars FROM thinkdpo_training")
def scan_parquet(f):
    return f.table("thinkdpo_training").select("pair_id", "list_id", "source", F.length("prompt").alias("prompt_chars"))


@query("SELECT list_id, n FROM lists WHERE len(pass_rates) > 0")
def scan_problems(f):
    return readers.scan_problems(f.lists, "pass_rates", "list_id").select("list_id", "n")


def _through_csv(f, writes: list[bool]) -> DataFrame:
    path = f"{shared_dir(f.spark)}/summary-{uuid.uuid4().hex}"
    for overwrite in writes:
        sinks.sink_csv(f.summary, path, overwrite)
    return readers.scan_csv_results(f.spark, path, "eval_llm string, data string, n bigint, chars bigint")


@query("SELECT * FROM summary")
def scan_csv_results(f):
    return _through_csv(f, [False])


@query("SELECT * FROM summary UNION ALL SELECT * FROM summary")
def sink_csv_append(f):
    return _through_csv(f, [False, False])


@query("SELECT * FROM summary")
def sink_csv_overwrite(f):
    return _through_csv(f, [False, True])


@query("SELECT list_id, n, CAST(0 AS INT) AS run, n >= 3 AS rankable FROM lists")
def sink_detail(f):
    path = f"{shared_dir(f.spark)}/detail-{uuid.uuid4().hex}"
    sinks.sink_detail(f.sizes, path, run=F.lit(0), rankable=_col("n") >= 3)
    return f.spark.read.parquet(path)


@query("SELECT list_id, coalesce(printf('%.2f', pass_rates[1]*100), 'N/A') AS percent, coalesce(printf('%.4f', pass_rates[1]), 'N/A') AS decimals FROM lists")
def fmt_metrics(f):
    first = F.get("pass_rates", F.lit(0))
    return f.lists.select("list_id", sinks.fmt_percent(first).alias("percent"), sinks.fmt_decimals(first).alias("decimals"))


@query("SELECT source AS eval_llm, lang AS data, arg_min(concat('out/', CAST(doc_id AS VARCHAR)), doc_id) AS path FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND n_chars > 300 GROUP BY ALL")
def cache_lookup(f):
    path = F.concat(F.lit("out/"), _col("doc_id").cast("string")).alias("path")
    rows = f.table("documents").select(_col("source").alias("eval_llm"), _col("lang").alias("data"), _col("doc_id").alias("row_no"), path)
    # the files that are there: those of the longer documents
    return readers.cache_lookup(rows, f.table("documents").where("n_chars > 300").select(path))


def _echo(prompts: list[str], n: int) -> list[list[str]]:
    return [[f"{len(p)}-{k}" for k in range(n)] for p in prompts]


@query("SELECT list_id, CAST(k AS INT) AS k, concat(CAST(length(query) AS VARCHAR), '-', CAST(k AS VARCHAR)) AS text FROM lists CROSS JOIN (SELECT k FROM ks WHERE k < 2) z WHERE query IS NOT NULL")
def scan_inference(f):
    return readers.scan_inference(f.lists.where("query is not null").select("list_id", _col("query").alias("prompt")), _echo, 2)


# Filters


@query("SELECT list_id FROM lists WHERE n = 2")
def filter_pairs_only(f):
    return f.lists.where("n = 2").select("list_id")


@query("SELECT list_id, n FROM lists WHERE n >= 3")
def filter_rankable(f):
    return f.lists.where("n >= 3").select("list_id", "n")


@query("SELECT * FROM summary WHERE data = 'en'")
def filter_results(f):
    return f.summary.where("data = 'en'")


@query("SELECT list_id, CAST(len(pass_rates) AS INT) AS tests FROM lists WHERE len(pass_rates) > 0")
def filter_has_tests(f):
    return f.lists.where(F.size("pass_rates") > 0).select("list_id", F.size("pass_rates").alias("tests"))


@query("SELECT list_id, i, j, winner FROM verdicts WHERE winner IS NOT NULL")
def drop_null_verdict(f):
    return f.verdicts.where("winner is not null").select("list_id", "i", "j", "winner")


# Prompts

_BLOCK = "string_agg(concat('[CANDIDATE_', chr(CAST(65 + pos AS INT)), ']', chr(10), '```', coalesce(c.language, ''), chr(10), coalesce(code, ''), chr(10), '```', chr(10), '[/CANDIDATE_', chr(CAST(65 + pos AS INT)), ']'), chr(10) || chr(10) ORDER BY pos)"
_LABELLED = f"SELECT c.list_id, {_BLOCK} AS labelled, any_value(c.query) AS query, any_value(c.language) AS language FROM (SELECT c.*, l.language, l.query FROM cand c JOIN lists l USING (list_id)) c WHERE pos < 5 GROUP BY c.list_id"
_T = P.TEMPLATES


def _filled(name: str, candidates: str = "labelled", query: str = "query", language: str = "language") -> str:
    out = "'" + _T[name].replace("'", "''") + "'"
    for place, value in (("language", language), ("candidates", candidates), ("query", query)):
        out = f"replace({out}, '{{{place}}}', coalesce({value}, ''))"
    return out


def _with_newlines(sql: str) -> str:
    return sql.replace("\n", "' || chr(10) || '")


@query(f"SELECT list_id, labelled FROM ({_LABELLED}) z")
def label_candidates(f):
    return f.lists.select("list_id", P.label_candidates(_col("candidates"), _col("n"), _col("language")).alias("labelled"))


def _prompt_columns(messages) -> list:
    part = lambda k, c: F.get(messages, F.lit(k))[c]
    return [F.size(messages).alias("messages"), part(0, "role").alias("role0"), part(0, "content").alias("content0"), part(1, "role").alias("role1"), part(1, "content").alias("content1")]


@query(f"SELECT list_id, CAST(2 AS INT) AS messages, 'user' AS role0, {_with_newlines(_filled('list_score'))} AS content0, 'assistant' AS role1, concat('<think>', chr(10)) AS content1 FROM ({_LABELLED}) z")
def build_prompt(f):
    return f.lists.select("list_id", *_prompt_columns(P.build_prompt(_col("query"), _col("language"), _col("candidates"), _col("n"), "some-grm-7b")))


@query(f"SELECT list_id, CAST(2 AS INT) AS messages, 'system' AS role0, '{_T['system']}' AS content0, 'user' AS role1, {_with_newlines(_filled('select'))} AS content1 FROM ({_LABELLED}) z")
def build_prompt_train(f):
    return f.lists.select("list_id", *_prompt_columns(P.build_prompt_train(_col("query"), _col("language"), _col("candidates"), _col("n"), thinking=False)))


_PAIRED = "SELECT list_id, query, replace(lower(language), '++', 'pp') AS language, concat('[CANDIDATE_A]', chr(10), '```', coalesce(replace(lower(language), '++', 'pp'), ''), chr(10), coalesce(CASE WHEN list_id % 2 = 0 THEN candidates[1] ELSE candidates[2] END, ''), chr(10), '```', chr(10), '[/CANDIDATE_A]', chr(10), chr(10), '[CANDIDATE_B]', chr(10), '```', coalesce(replace(lower(language), '++', 'pp'), ''), chr(10), coalesce(CASE WHEN list_id % 2 = 0 THEN candidates[2] ELSE candidates[1] END, ''), chr(10), '```', chr(10), '[/CANDIDATE_B]') AS labelled FROM lists"


@query(f"SELECT list_id, CAST(2 AS INT) AS messages, 'user' AS role0, {_with_newlines(_filled('select'))} AS content0, 'assistant' AS role1, concat('<think>', chr(10)) AS content1 FROM ({_PAIRED}) z")
def build_prompt_pair(f):
    first, second = F.get("candidates", F.lit(0)), F.get("candidates", F.lit(1))
    return f.lists.select("list_id", *_prompt_columns(P.build_prompt_pair(_col("query"), _col("language"), first, second, _col("list_id"), "plain")))


@query("SELECT pair_id, 'user' AS prompt_role, prompt AS prompt_content, 'assistant' AS chosen_role, chosen AS chosen_content FROM thinkdpo_training")
def to_messages(f):
    m = f.table("thinkdpo_training").select("pair_id", P.to_messages(_col("prompt"), "user").alias("p"), P.to_messages(_col("chosen"), "assistant").alias("c"))
    return m.select("pair_id", _col("p")[0]["role"].alias("prompt_role"), _col("p")[0]["content"].alias("prompt_content"), _col("c")[0]["role"].alias("chosen_role"), _col("c")[0]["content"].alias("chosen_content"))


@query("SELECT event_id, lower(event_type) AS platform, lower(event_type) = 'leetcode' AS functional, coalesce(nullif(json_extract_string(props, '$.k'), ''), 'solve') AS func_name FROM events")
def problem_meta(f):
    props = F.replace(_col("props"), F.lit('"k"'), F.lit('"func_name"'))
    return f.table("events").select("event_id", P.problem_meta(_col("event_type"), props).alias("m")).select("event_id", "m.*")


@query(f"SELECT list_id, '{_T['system']}' || chr(10) || chr(10) || replace(replace(CASE WHEN n = 2 THEN {_with_newlines(repr(_T['functional']).replace(chr(92) + 'n', chr(10)))} ELSE {_with_newlines(repr(_T['stdin']).replace(chr(92) + 'n', chr(10)))} END, '{{starter}}', CASE WHEN coalesce(language, '') <> '' THEN chr(10) || language ELSE '' END), '{{query}}', coalesce(trim(regexp_replace(query, '<[^>]+>', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)), '')) AS content FROM lists")
def build_codegen_prompt(f):
    m = P.build_codegen_prompt(_col("query"), _col("language"), _col("n") == 2)
    return f.lists.select("list_id", m[0]["content"].alias("content"))


_PLAIN = "trim(regexp_replace(query, '<[^>]+>', '', 'g'), ' ' || chr(9) || chr(10) || chr(13))"


@query(f"SELECT list_id, {_with_newlines(_filled('list_score', query=_PLAIN, language=chr(39) + 'python' + chr(39)))} AS content FROM ({_LABELLED.replace('c.language', chr(39) + 'python' + chr(39)).replace('any_value(' + chr(39) + 'python' + chr(39) + ') AS language', '1 AS language')}) z")
def build_list_prompt(f):
    m = P.build_list_prompt(_col("query"), _col("candidates"), _col("n"), scoring=True, thinking=True)
    return f.lists.select("list_id", m[0]["content"].alias("content"))


_TWO = "SELECT list_id, trim(regexp_replace(query, '<[^>]+>', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS query, 'python' AS language, concat('[CANDIDATE_A]', chr(10), '```python', chr(10), coalesce(candidates[1], ''), chr(10), '```', chr(10), '[/CANDIDATE_A]', chr(10), chr(10), '[CANDIDATE_B]', chr(10), '```python', chr(10), coalesce(candidates[2], ''), chr(10), '```', chr(10), '[/CANDIDATE_B]') AS labelled FROM lists"


@query(f"SELECT list_id, CAST(2 AS INT) AS messages, 'system' AS role0, '{_T['system']}' AS content0, 'user' AS role1, {_with_newlines(_filled('select'))} AS content1 FROM ({_TWO}) z")
def build_pair_prompt(f):
    first, second = F.get("candidates", F.lit(0)), F.get("candidates", F.lit(1))
    return f.lists.select("list_id", *_prompt_columns(P.build_pair_prompt(_col("query"), first, second, scoring=False, thinking=False)))


@query("SELECT list_id, k, CASE WHEN strpos(text, chr(92) || 'boxed{') > 0 THEN substr(text, 1, strpos(text, chr(92) || 'boxed{') + 6) END AS cut FROM comp")
def truncate_at_boxed(f):
    return f.comp.select("list_id", "k", X.truncate_at_boxed(_col("text")).alias("cut"))


@query("""SELECT list_id, CASE WHEN len(cuts) > 0 THEN cuts[CAST(h % len(cuts) AS INT) + 1] ELSE concat(coalesce(texts[CAST(h % len(texts) AS INT) + 1], 'None'), chr(92), 'boxed{') END AS picked
FROM (SELECT list_id, list_id * 7919 % 104729 AS h, list(text ORDER BY k) AS texts, list(substr(text, 1, strpos(text, chr(92) || 'boxed{') + 6) ORDER BY k) FILTER (strpos(text, chr(92) || 'boxed{') > 0) AS cuts FROM comp GROUP BY list_id) z""")
def pick_continuation(f):
    texts = F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"])
    per = f.comp.groupBy("list_id").agg(texts.alias("texts"))
    return per.select("list_id", P.pick_continuation(_col("texts"), _col("list_id") * 7919 % 104729).alias("picked"))


@query("SELECT pair_id, CAST(2 AS INT) AS messages, 'assistant' AS role1, concat('<think>', chr(10), chosen) AS content1 FROM thinkdpo_training")
def extend_messages(f):
    base = F.array(P.message("user", _col("prompt")), P.message("assistant", F.lit(P.OPEN_THINK)))
    m = f.table("thinkdpo_training").select("pair_id", P.extend_messages(base, _col("chosen")).alias("m"))
    return m.select("pair_id", F.size("m").alias("messages"), _col("m")[1]["role"].alias("role1"), _col("m")[1]["content"].alias("content1"))


@query("SELECT pair_id, concat('<s>', 'sys', '<U>', prompt, '<A>', chosen, '</s>', '<A><think>', chr(10)) AS rendered FROM thinkdpo_training WHERE prompt IS NOT NULL AND chosen IS NOT NULL")
def render_chat(f):
    messages = F.array(P.message("system", F.lit("sys")), P.message("user", _col("prompt")), P.message("assistant", _col("chosen")))
    pairs = f.table("thinkdpo_training").where("prompt is not null and chosen is not null")
    return pairs.select("pair_id", P.render_chat(messages, "<s>", "<U>", "<A>", "</s>", True).alias("rendered"))


# Text functions

_BOX = "CASE WHEN regexp_matches({0}, '\\\\boxed\\{{(.*?)\\}}') THEN regexp_extract({0}, '\\\\boxed\\{{(.*?)\\}}', 1) END"
_TAIL = "regexp_replace(split_part({0}, '</think>', -1), '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT list_id, k, {_BOX.format('text')} AS said FROM comp")
def boxed_text(f):
    return f.comp.select("list_id", "k", X.boxed_text(_col("text")).alias("said"))


@query("SELECT list_id, k, answer FROM answers")
def boxed_text_eval(f):
    return f.answers.select("list_id", "k", "answer")


_TAIL_OF_SCORES = f"SELECT *, {_BOX.format(_TAIL.format('text'))} AS inner_text FROM scores"
_SCORED = f"""(SELECT *, CASE WHEN regexp_matches(inner_text, '^\\[[0-9]+(, [0-9]+)*,?\\]$') THEN list_transform(list_filter(string_split(regexp_replace(inner_text, '[\\[\\] ]', '', 'g'), ','), lambda x: x <> ''), lambda x: CAST(x AS INT)) ELSE [] END AS s FROM ({_TAIL_OF_SCORES}) y)"""


@query(f"SELECT list_id, k, array_to_string(list_transform(s, lambda x: CAST(x AS VARCHAR)), '/') AS said FROM {_SCORED} z")
def boxed_scores(f):
    s = X.boxed_scores(X.post_think(_col("text")))
    return f.scores.select("list_id", "k", F.array_join(s.cast("array<string>"), "/").alias("said"))


@query(f"SELECT list_id, k, {_TAIL.format('text')} AS tail FROM comp")
def post_think(f):
    return f.comp.select("list_id", "k", X.post_think(_col("text")).alias("tail"))


@query("SELECT list_id, pos, coalesce(trim(regexp_replace(code, '<[^>]+>', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)), '') AS plain FROM cand")
def strip_html(f):
    return f.cand.select("list_id", "pos", X.strip_html(_col("code")).alias("plain"))


@query()
def extract_code(f):
    return f.table("documents").select("doc_id", X.extract_code(_col("text")).alias("code"))


_LETTER_AT = f"CASE WHEN regexp_matches({_BOX.format(_TAIL.format('text'))}, '^[A-H]$') THEN ascii({_BOX.format(_TAIL.format('text'))}) - 65 END"
_TOP = "CASE WHEN len(s) = n AND len(list_filter(s, lambda x: x = list_max(s))) = 1 THEN CAST(list_position(s, list_max(s)) - 1 AS INT) END"


@query(f"SELECT list_id, k, CAST(CASE WHEN {_LETTER_AT} < n THEN {_LETTER_AT} END AS INT) AS sel FROM comp")
def list_verdict(f):
    return f.comp.select("list_id", "k", X.list_verdict(_col("text"), _col("n")).cast("int").alias("sel"))


@query(f"SELECT list_id, k, {_TOP} AS sel FROM {_SCORED} z")
def list_verdict_scored(f):
    return f.scores.select("list_id", "k", X.list_verdict(_col("text"), _col("n"), scoring=True).alias("sel"))


@query(f"SELECT list_id, k, CASE WHEN said IN ('A', 'B') THEN said END AS verdict FROM (SELECT *, {_BOX.format(_TAIL.format('text'))} AS said FROM comp) z")
def pair_verdict(f):
    return f.comp.select("list_id", "k", X.pair_verdict(_col("text")).alias("verdict"))


@query("SELECT record_id, i, j, CASE upper(trim(raw, ' ' || chr(9) || chr(10) || chr(13))) WHEN 'A' THEN i WHEN 'B' THEN j END AS said FROM ranking_consistency")
def interpret_pair(f):
    return f.table("ranking_consistency").select("record_id", "i", "j", X.interpret_pair(_col("raw"), _col("i"), _col("j")).alias("said"))


@query("SELECT prob_id, cand, tc_id, rtrim(stdout, ' ' || chr(10)) AS clean FROM executions")
def normalize_output(f):
    return f.executions.select("prob_id", "cand", "tc_id", X.normalize_output(_col("stdout")).alias("clean"))


@query(f"SELECT prob_id, cand, tc_id, {SAME} AS same FROM executions")
def outputs_match(f):
    return f.executions.select("prob_id", "cand", "tc_id", X.outputs_match(_col("stdout"), _col("expected")).alias("same"))


@query()
def functional_harness(f):
    return f.cand.where("code is not null").select("list_id", "pos", X.functional_harness(_col("code"), F.lit("solve"), F.concat_ws("\n", _col("pos").cast("string"), F.lit("[1, 2]"))).alias("source"))


@query("SELECT t.list_id, min(CAST(floor((t.opens + 7 - 1) / 3) AS INT)) AS box_token FROM (SELECT list_id, strpos(text, chr(92) || 'boxed{') AS opens, length(text) AS n FROM comp WHERE k = 0 AND text IS NOT NULL) t WHERE opens > 0 AND n > opens - 1 + 7 GROUP BY t.list_id")
def box_token_index(f):
    return V.box_token_index(f.tokens)


@query("SELECT DISTINCT lower(policy) AS short FROM policies")
def model_short_name(f):
    return f.table("policies").select(X.model_short_name(F.concat(F.lit("Org/Team/"), F.upper("policy"))).alias("short")).distinct()


@query("SELECT policy, CASE WHEN contains(lower(policy), 'it') THEN 1 ELSE 0 END AS thinking, CASE WHEN contains(lower(policy), 'it') THEN 'list_correct+list_format' ELSE 'list_correct_cot+list_format_cot' END || '+overlong_penalty' AS rewards FROM policies")
def reward_set(f):
    path = F.when(F.contains(F.lower("policy"), F.lit("it")), F.concat(F.lit("DeepSeek-"), "policy")).otherwise(_col("policy"))
    names = F.array_join(R.reward_set(path, F.lit("dapo")), "+")
    return f.table("policies").select("policy", F.contains(F.lower("policy"), F.lit("it")).cast("int").alias("thinking"), names.alias("rewards"))


# Rewards

_STRIPPED = "regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')"
_FORMED = "(starts_with({t}, '<think>') AND NOT contains(substr({t}, 8), '<think>') AND regexp_matches({t}, {p}, 's'))"
_THOUGHT = "'^<think>.*</think>\\s*\\\\boxed\\{'"


@query("SELECT list_id, k, CAST(CASE WHEN len <= 20 THEN 0 WHEN len <= 30 THEN (20 - len) / CAST(10 AS DOUBLE) ELSE -1 END AS DOUBLE) AS reward FROM (SELECT list_id, k, length(coalesce(text, '')) AS len FROM comp) z")
def overlong_penalty(f):
    return f.comp.select("list_id", "k", R.overlong_penalty(F.length(F.coalesce("text", F.lit(""))), 30, 10).alias("reward"))


@query(f"SELECT list_id, k, CAST(CASE WHEN {_FORMED.format(t=_STRIPPED, p=_THOUGHT + ' || ' + chr(39) + '[A-' + chr(39) + ' || chr(CAST(64 + n AS INT)) || ' + chr(39) + chr(93) + chr(92) + '}$' + chr(39))} THEN 0 ELSE -1 END AS DOUBLE) AS reward FROM comp")
def list_format(f):
    return f.comp.select("list_id", "k", R.list_format(_col("text"), _col("n")).alias("reward"))


@query(f"SELECT list_id, k, CAST(CASE WHEN {_BOX.format(_TAIL.format('text'))} = chosen_answer THEN 1 ELSE 0 END AS DOUBLE) AS reward FROM comp")
def list_correct(f):
    return f.comp.select("list_id", "k", R.list_correct(_col("text"), _col("chosen_answer")).alias("reward"))


@query(f"SELECT list_id, k, CAST(CASE WHEN regexp_matches({_STRIPPED}, '\\\\boxed\\{{[A-' || chr(CAST(64 + n AS INT)) || ']\\}}$') THEN 0 ELSE -1 END AS DOUBLE) AS reward FROM comp")
def list_format_cot(f):
    return f.comp.select("list_id", "k", R.list_format_cot(_col("text"), _col("n")).alias("reward"))


@query(f"SELECT list_id, k, CAST(CASE WHEN {_BOX.format('text')} = chosen_answer THEN 1 ELSE 0 END AS DOUBLE) AS reward FROM comp")
def list_correct_cot(f):
    return f.comp.select("list_id", "k", R.list_correct_cot(_col("text"), _col("chosen_answer")).alias("reward"))


@query(f"""SELECT c.list_id, c.k, CAST(coalesce(CASE WHEN r.rank = 0 THEN 1.0 ELSE -(c.n - 0) * 0.2 + (c.n - 1 - r.rank) * 0.2 + 0.2 END, -1) AS DOUBLE) AS unused, coalesce(r.reward, CAST(-1 AS DOUBLE)) AS reward
FROM (SELECT *, {_LETTER_AT} AS at FROM comp) c LEFT JOIN (SELECT list_id, pos, rank, CASE WHEN rank = 0 THEN CAST(1 AS DOUBLE) ELSE round(CAST(-0.2 AS DOUBLE) * (rank + 5 - n), 9) END AS reward FROM (SELECT list_id, pos, n, row_number() OVER (PARTITION BY list_id ORDER BY pass_rate DESC, pos) - 1 AS rank FROM cand WHERE pass_rate IS NOT NULL) x) r ON c.list_id = r.list_id AND c.at = r.pos""".replace("CAST(coalesce(CASE WHEN r.rank = 0 THEN 1.0 ELSE -(c.n - 0) * 0.2 + (c.n - 1 - r.rank) * 0.2 + 0.2 END, -1) AS DOUBLE) AS unused, ", ""))
def list_distance(f):
    return f.comp.select("list_id", "k", F.round(R.list_distance(_col("text"), _col("pass_rates"), _col("n")), 9).alias("reward"))


@query(f"SELECT list_id, k, CAST(CASE WHEN {_TOP} = chosen_position AND list_max(s) = 10 THEN 2 WHEN {_TOP} = chosen_position THEN 1 ELSE -1 END AS DOUBLE) AS reward FROM {_SCORED} z")
def listsc_correct(f):
    return f.scores.select("list_id", "k", R.listsc_correct(_col("text"), _col("n"), _col("chosen_position")).alias("reward"))


@query(f"""SELECT list_id, k, CASE WHEN len(s) <> 2 OR ga IS NULL OR gb IS NULL THEN CAST(-2 AS DOUBLE) ELSE round(CASE WHEN same THEN 2e0 ELSE -1.5e0 END + CASE WHEN off = 0 THEN 1e0 WHEN same AND off <= 2 THEN 0.6e0 ELSE 0e0 END + CASE WHEN same AND abs(s[1] - s[2]) >= abs(ga - gb) THEN 0.2e0 ELSE 0e0 END, 2) END AS reward
FROM (SELECT *, sign(s[1] - s[2]) = sign(ga - gb) AS same, abs(s[1] - ga) + abs(s[2] - gb) AS off FROM (SELECT *, round_even(pass_rates[1]*10, 0) AS ga, round_even(pass_rates[2]*10, 0) AS gb FROM {_SCORED} z WHERE n = 2) y) x""")
def pairsc_content(f):
    return f.scores.where("n = 2").select("list_id", "k", R.pairsc_content(_col("text"), _col("pass_rates")).alias("reward"))


_NUMBERS = "'\\[\\d+' || repeat(',\\s*\\d+', {n} - 1) || '\\]\\}}$'"


@query(f"SELECT list_id, k, CAST(CASE WHEN formed AND len(s) = 2 THEN CASE WHEN list_max(s) <= 10 THEN 1 ELSE -0.5 END ELSE -1 END AS DOUBLE) AS reward FROM (SELECT *, {_FORMED.format(t=_STRIPPED, p=_THOUGHT + ' || ' + _NUMBERS.format(n=2))} AS formed FROM {_SCORED} z) y")
def pairsc_format(f):
    return f.scores.select("list_id", "k", R.pairsc_format(_col("text")).alias("reward"))


@query(f"SELECT list_id, k, CAST(CASE WHEN {_FORMED.format(t=_STRIPPED, p=_THOUGHT + ' || ' + _NUMBERS.format(n='n'))} THEN 0 ELSE -1 END AS DOUBLE) AS reward FROM scores")
def listsc_format(f):
    return f.scores.select("list_id", "k", R.listsc_format(_col("text"), _col("n")).alias("reward"))


@query(f"SELECT list_id, k, coalesce({_TOP.replace('CAST(list_position(s, list_max(s)) - 1 AS INT)', 'chr(CAST(64 + list_position(s, list_max(s)) AS INT))')}, 'Invalid') AS said FROM {_SCORED} z")
def extract_option_answer(f):
    return f.scores.select("list_id", "k", P.extract_option_answer(X.boxed_scores(X.post_think(_col("text"))), _col("n")).alias("said"))


# Joins


@query("SELECT v.list_id, v.i, v.j, l.source FROM verdicts v JOIN lists l ON v.list_id = l.list_id")
def join_list_meta(f):
    return f.verdicts.join(f.lists.select("list_id", "source"), "list_id").select("list_id", "i", "j", "source")


@query("SELECT p.list_id, coalesce(l.n, 0) AS n FROM (SELECT DISTINCT list_id FROM verdicts) p LEFT JOIN lists l ON p.list_id = l.list_id")
def join_list_size_default(f):
    return f.verdicts.select("list_id").distinct().join(f.sizes, "list_id", "left").select("list_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT a.list_id, a.pos AS i, b.pos AS j FROM cand a JOIN cand b ON a.list_id = b.list_id AND a.pos < b.pos")
def self_join_pairs(f):
    return K.pairs_of(f.sizes)


_EDGES = "(SELECT list_id, least(winner, loser) AS x, greatest(winner, loser) AS y, max(CASE WHEN winner < loser THEN 1 ELSE 0 END) AS low FROM prefs GROUP BY ALL)"
_TRIPLES = f"SELECT ab.list_id, ab.x AS a, ab.y AS b, bc.y AS c, NOT (ab.low = bc.low AND ac.low <> ab.low) AS transitive FROM {_EDGES} ab JOIN {_EDGES} bc ON ab.list_id = bc.list_id AND ab.y = bc.x JOIN {_EDGES} ac ON ac.list_id = ab.list_id AND ac.x = ab.x AND ac.y = bc.y"


@query(_TRIPLES)
def triple_join(f):
    return K.triple_join(f.prefs)


@query("SELECT c.list_id, c.k, l.chosen_answer FROM comp c JOIN lists l ON c.list_id = l.list_id")
def zip_join(f):
    return f.comp.select("list_id", "k").join(f.truth, "list_id")


@query("SELECT list_id, token_id, opt FROM logprobs")
def join_option_tokens(f):
    return f.logprobs.join(F.broadcast(f.option_tokens), "token_id").select("list_id", "token_id", "opt")


@query("SELECT s.* FROM summary s WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.source = s.eval_llm AND d.lang = s.data AND d.contest_id IS NULL)")
def anti_join_existing(f):
    done = f.table("documents").where("contest_id is null").select(_col("source").alias("eval_llm"), _col("lang").alias("data"))
    return f.summary.join(done, ["eval_llm", "data"], "left_anti")


# Aggregations

_MAJORITY = "SELECT list_id, answer FROM (SELECT list_id, answer, row_number() OVER (PARTITION BY list_id ORDER BY count(*) DESC, min(k)) AS rn FROM answers GROUP BY list_id, answer) z WHERE rn = 1"


@query(f"SELECT count(*) AS lists, round(avg(CASE WHEN m.answer IS NOT DISTINCT FROM l.chosen_answer THEN 1e0 ELSE 0e0 END), 9) AS sc FROM ({_MAJORITY}) m JOIN lists l USING (list_id)")
def sc_accuracy(f):
    return V.sc_accuracy(f.answers.select("list_id", "k", "answer"), f.truth)


@query("SELECT count(hit) AS lists, round(avg(hit), 9) AS bon FROM (SELECT a.list_id, CASE WHEN count(*) > 1 THEN max(CASE WHEN a.answer IS NOT DISTINCT FROM l.chosen_answer THEN 1e0 ELSE 0e0 END) END AS hit FROM answers a JOIN lists l USING (list_id) GROUP BY a.list_id) z")
def bon_accuracy(f):
    return V.bon_accuracy(f.answers.select("list_id", "answer"), f.truth)


@query("SELECT l.list_id, r.n_votes, r.predicted, r.conf, CASE WHEN r.conf IS NOT NULL THEN (SELECT round(CAST(coalesce(sum(v.votes), 0) AS DOUBLE) / r.n_votes, 9) FROM votes v WHERE v.list_id = l.list_id AND v.opt = 'A') END AS share_a FROM lists l JOIN records r ON r.list_id = l.list_id")
def vote_distribution(f):
    d = V.vote_distribution(f.answers.select("list_id", "answer"), f.sizes)
    return d.select("list_id", F.when(_col("conf").isNotNull(), _col("n_votes")).alias("n_votes"), "predicted", "conf", F.round(F.try_element_at("dist", F.lit("A")), 9).alias("share_a"))


@query("SELECT * FROM softmax")
def option_softmax(f):
    return V.option_softmax(f.logprobs, f.option_tokens, f.sizes)


@query("SELECT s.list_id, s.predicted, s.conf, CAST(s.predicted = l.chosen_answer AS INT) AS is_correct FROM (SELECT list_id, arg_min(opt, (-p, opt)) AS predicted, max(p) AS conf FROM softmax WHERE p IS NOT NULL GROUP BY list_id) s JOIN lists l USING (list_id)")
def argmax_option(f):
    return V.argmax_option(V.option_softmax(f.logprobs, f.option_tokens, f.sizes), f.truth)


_BINS = "(SELECT CAST(b AS INT) AS bin, b*1e-1 AS lo, CASE WHEN b = 9 THEN 1e0 ELSE (b + 1)*1e-1 END AS hi FROM (SELECT unnest(range(0, 10)) AS b) z)"
_BINNED = f"SELECT b.bin, count(r.conf) AS n, avg(r.conf) AS conf, avg(CAST(r.is_correct AS DOUBLE)) AS acc FROM {_BINS} b LEFT JOIN records r ON r.conf <= b.hi AND (r.conf > b.lo OR (b.bin = 0 AND r.conf = b.lo)) GROUP BY b.bin"


@query(f"SELECT bin, n, round(conf, 9) AS conf, round(acc, 9) AS acc FROM ({_BINNED}) z")
def ece_bins(f):
    return C.bins(f.records).select("bin", "n", F.round("conf", 9).alias("conf"), F.round("acc", 9).alias("acc"))


@query(f"SELECT round(sum(n * abs(conf - acc)) / sum(n), 9) AS ece FROM ({_BINNED}) z")
def ece(f):
    return C.ece(f.records)


@query("SELECT round(avg(pow(conf - is_correct, 2)), 9) AS brier FROM records WHERE conf IS NOT NULL")
def brier(f):
    return C.brier(f.records)


@query("SELECT count(*) AS n_total, count(conf) AS n_valid, round(coalesce(avg(CAST(is_correct AS DOUBLE)), 0), 9) AS accuracy, round(coalesce(avg(conf), 0), 9) AS mean_conf FROM records")
def calibration_summary(f):
    return C.calibration_summary(f.records)


@query("SELECT list_id, pos, wins FROM wins")
def win_counts(f):
    return K.win_counts(f.prefs, f.cand).select("list_id", "pos", "wins")


@query("SELECT * FROM prefs")
def preference_set(f):
    return f.prefs


_PER_LIST = f"SELECT p.list_id, l.n, coalesce(t.triples, 0) AS triples, coalesce(t.transitive, 0) AS transitive FROM (SELECT DISTINCT list_id FROM prefs) p JOIN lists l ON l.list_id = p.list_id AND l.n >= 3 LEFT JOIN (SELECT t.list_id, count(*) AS triples, count(*) FILTER (transitive) AS transitive FROM ({_TRIPLES}) t JOIN lists l ON t.list_id = l.list_id AND t.c < l.n GROUP BY t.list_id) t ON t.list_id = p.list_id"


@query(_PER_LIST)
def transitivity_per_list(f):
    return K.transitivity_per_list(f.prefs, f.sizes)


@query(f"SELECT CAST(sum(triples) AS BIGINT) AS triples, CAST(sum(transitive) AS BIGINT) AS transitive, round(CAST(sum(transitive) AS DOUBLE) / sum(triples), 9) AS rate FROM ({_PER_LIST}) z")
def transitivity(f):
    return K.transitivity(f.prefs, f.sizes)


_NDCG = "SELECT list_id, n, round(sum(g / log2(a + 1)) / sum(g / log2(b + 1)), 9) AS ndcg FROM (SELECT list_id, n, pow(2e0, pass_rate) - 1 AS g, row_number() OVER (PARTITION BY list_id ORDER BY wins DESC, pos) AS a, row_number() OVER (PARTITION BY list_id ORDER BY pass_rate DESC, pos) AS b FROM wins WHERE pass_rate IS NOT NULL) z GROUP BY list_id, n HAVING sum(g) <> 0"


@query(_NDCG)
def ndcg_per_list(f):
    return K.ndcg_per_list(f.prefs, f.cand)


@query(f"SELECT count(*) AS lists, round(avg(ndcg), 6) AS ndcg FROM ({_NDCG}) z")
def ndcg(f):
    return K.ndcg(f.prefs, f.cand)


_TAU = "SELECT a.list_id, a.n, round(CASE WHEN sum(abs(sign(a.wins - b.wins))) * sum(abs(sign(a.pass_rate - b.pass_rate))) > 0 THEN sum(sign(a.wins - b.wins) * sign(a.pass_rate - b.pass_rate)) / sqrt(sum(abs(sign(a.wins - b.wins))) * sum(abs(sign(a.pass_rate - b.pass_rate)))) ELSE -1e0 END, 9) AS tau FROM wins a LEFT JOIN wins b ON a.list_id = b.list_id AND a.pos < b.pos AND b.pass_rate IS NOT NULL WHERE a.pass_rate IS NOT NULL GROUP BY a.list_id, a.n"


@query(_TAU)
def tau_per_list(f):
    return K.tau_per_list(f.prefs, f.cand)


@query(f"SELECT count(*) AS lists, round(avg(tau), 6) AS tau FROM ({_TAU}) z")
def kendall_tau_b(f):
    return K.kendall_tau_b(f.prefs, f.cand)


@query("SELECT count(*) AS compared, round(avg(CASE WHEN (a.pass_rate > b.pass_rate) = (v.winner = v.i) THEN 1e0 ELSE 0e0 END), 9) AS accuracy FROM verdicts v JOIN cand a ON a.list_id = v.list_id AND a.pos = v.i JOIN cand b ON b.list_id = v.list_id AND b.pos = v.j WHERE v.winner IS NOT NULL AND a.pass_rate <> b.pass_rate")
def pairwise_accuracy(f):
    return K.pairwise_accuracy(f.verdicts, f.cand)


_SELECTED = "SELECT l.list_id AS prob_id, s.sel FROM lists l LEFT JOIN (SELECT list_id, winner AS sel FROM (SELECT list_id, winner, row_number() OVER (PARTITION BY list_id ORDER BY count(*) DESC, winner) AS rn FROM verdicts WHERE winner IS NOT NULL GROUP BY list_id, winner) z WHERE rn = 1) s ON s.list_id = l.list_id"


def _selected(f) -> DataFrame:
    return S.select_pairwise(f.verdicts.withColumnRenamed("list_id", "prob_id"), f.lists.select(_col("list_id").alias("prob_id")))


@query(_SELECTED)
def select_pairwise(f):
    return _selected(f)


#: Both orders of each pair, as text of both dialects; in some the first one shown wins whatever it is.
_BOTH_ORDERS = """CASE WHEN winner IS NULL THEN 'no verdict' WHEN swapped AND (list_id + i + j) % 4 = 0 THEN concat('<think>x</think>', chr(92), 'boxed{A}')
  WHEN (winner = i) <> swapped THEN concat(chr(92), 'boxed{A}') ELSE concat(chr(92), 'boxed{B}') END"""


@query(f"""SELECT l.list_id AS prob_id, sel FROM lists l LEFT JOIN (SELECT list_id, arg_min(won, (-wins, won)) AS sel FROM (
  SELECT list_id, won, count(*) AS wins FROM (SELECT list_id, CASE WHEN (text LIKE '%{{A}}') <> swapped THEN i ELSE j END AS won FROM (SELECT *, {_BOTH_ORDERS} AS text FROM verdicts CROSS JOIN (SELECT unnest([true, false]) AS swapped) s) t WHERE text LIKE '%boxed%') u GROUP BY ALL) w GROUP BY list_id) s ON s.list_id = l.list_id""")
def select_pairwise_both_orders(f):
    orders = f.verdicts.select("list_id", "i", "j", "winner", F.explode(F.array(F.lit(True), F.lit(False))).alias("swapped"))
    answers = orders.select(_col("list_id").alias("prob_id"), "i", "j", "swapped", F.expr(_BOTH_ORDERS).alias("text"))
    return S.select_pairwise(S.pair_winners(answers), f.lists.select(_col("list_id").alias("prob_id")))


@query(f"SELECT list_id AS prob_id, CAST(CASE WHEN {_LETTER_AT} < n THEN {_LETTER_AT} END AS INT) AS sel FROM comp WHERE k = 0")
def select_list(f):
    first = f.comp.where("k = 0").select(_col("list_id").alias("prob_id"), "text", "n")
    return S.select_list(first).select("prob_id", _col("sel").cast("int").alias("sel"))


@query("SELECT * FROM counts")
def test_pass_count(f):
    return f.counts


@query(f"SELECT count(*) AS problems, round(avg(CASE WHEN s.sel IS NOT NULL AND c.passed = c.total THEN 1e0 ELSE 0e0 END), 9) AS pass_at_1 FROM ({_SELECTED}) s JOIN (SELECT prob_id, max(cand) AS last FROM counts GROUP BY prob_id) m ON m.prob_id = s.prob_id LEFT JOIN counts c ON c.prob_id = s.prob_id AND c.cand = least(s.sel, m.last)")
def pass_at_1(f):
    return S.pass_at_1(_selected(f), f.counts)


@query("SELECT count(*) AS problems, round(avg(good), 9) AS oracle FROM (SELECT prob_id, max(CASE WHEN passed = total THEN 1e0 ELSE 0e0 END) AS good FROM counts GROUP BY prob_id) z")
def oracle_pass(f):
    return S.oracle_pass(f.counts)


@query("SELECT count(*) AS problems, round(avg(CASE WHEN passed = total THEN 1e0 ELSE 0e0 END), 9) AS random FROM (SELECT *, count(*) OVER (PARTITION BY prob_id) AS n FROM counts) z WHERE cand = (prob_id*31) % n")
def random_pass(f):
    return S.random_pass(f.counts)


@query("SELECT count(*) AS total, count(winner) AS parsed FROM verdicts")
def verdict_coverage(f):
    return f.verdicts.agg(*V.verdict_coverage(_col("winner")))


@query(f"SELECT 'sc' AS metric, (SELECT round(avg(CASE WHEN m.answer IS NOT DISTINCT FROM l.chosen_answer THEN 1e0 ELSE 0e0 END), 9) FROM ({_MAJORITY}) m JOIN lists l USING (list_id)) AS value UNION ALL SELECT 'ece', (SELECT round(sum(n * abs(conf - acc)) / sum(n), 9) FROM ({_BINNED}) z) UNION ALL SELECT 'ndcg', (SELECT round(avg(ndcg), 6) FROM ({_NDCG}) z) UNION ALL SELECT 'tau', (SELECT round(avg(tau), 6) FROM ({_TAU}) z)")
def unify_metrics(f):
    rows = [(V.sc_accuracy(f.answers.select("list_id", "k", "answer"), f.truth), "sc"), (C.ece(f.records), "ece"), (K.ndcg(f.prefs, f.cand), "ndcg"), (K.kendall_tau_b(f.prefs, f.cand), "tau")]
    out = None
    for df, name in rows:
        one = df.select(F.lit(name).alias("metric"), _col(name).alias("value"))
        out = one if out is None else out.union(one)
    return out


# Order, limits and picks


@query("SELECT list_id, CAST(row_number() OVER (ORDER BY list_id) AS INT) AS place FROM lists")
def sort_by_prompt_id(f):
    return _numbered(f).select("list_id", "place")


def _numbered(f) -> DataFrame:
    """(list_id, place, total) in total order without one task for all rows: range partitions, written once, numbered from
    their counts (one row per partition)."""
    parts = int(f.spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = f.lists.select("list_id").repartitionByRange(parts, "list_id").withColumn("part", F.spark_partition_id())
    ordered = materialize(ordered, "ordered")
    sums = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ordered.groupBy("part").agg(F.count("*").alias("rows")).withColumn("before", F.coalesce(F.sum("rows").over(sums), F.lit(0))).withColumn("total", F.sum("rows").over(Window.partitionBy()))
    numbered = ordered.withColumn("rn", F.row_number().over(Window.partitionBy("part").orderBy("list_id")))
    return numbered.join(F.broadcast(counts), "part").select("list_id", (_col("rn") + _col("before")).cast("int").alias("place"), "total")


@query("SELECT list_id, pos, CAST(row_number() OVER (PARTITION BY list_id ORDER BY pass_rate DESC NULLS LAST, pos) AS INT) AS place FROM cand")
def sort_by_score(f):
    w = Window.partitionBy("list_id").orderBy(_col("pass_rate").desc_nulls_last(), "pos")
    return f.cand.select("list_id", "pos", F.row_number().over(w).alias("place"))


@query("SELECT list_id, n FROM lists ORDER BY list_id LIMIT 100")
def limit_head(f):
    return f.sizes.orderBy("list_id").limit(100)


@query("SELECT pair_id, md5(concat(CAST(pair_id AS VARCHAR), ':42')) AS key FROM thinkdpo_training")
def shuffle_seeded(f):
    return f.table("thinkdpo_training").select("pair_id", F.md5(F.concat(_col("pair_id").cast("string"), F.lit(":42"))).alias("key")).orderBy("key", "pair_id")


@query("SELECT a.list_id, a.pos AS i, b.pos AS j, a.code AS code_i, b.code AS code_j FROM cand a JOIN cand b ON a.list_id = b.list_id AND a.pos < b.pos WHERE a.n >= 3")
def explode_pairs(f):
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), _col("n") - 2), lambda i: F.transform(F.sequence(i + 1, _col("n") - 1), lambda j: F.struct(i.alias("i"), j.alias("j"), F.get("candidates", i).alias("code_i"), F.get("candidates", j).alias("code_j")))))
    return f.lists.where("n >= 3").select("list_id", F.inline(pairs))


@query("SELECT list_id, i, j, CASE WHEN (list_id*7 + i*3 + j) % 2 = 0 THEN 'A' ELSE 'B' END AS raw FROM verdicts")
def random_baseline(f):
    return f.verdicts.select("list_id", "i", "j", F.when((_col("list_id") * 7 + _col("i") * 3 + _col("j")) % 2 == 0, "A").otherwise("B").alias("raw"))


@query("SELECT list_id AS prob_id, CAST((list_id*31) % n AS INT) AS sel FROM lists")
def random_selection(f):
    return f.lists.select(_col("list_id").alias("prob_id"), ((_col("list_id") * 31) % _col("n")).cast("int").alias("sel"))


@query("SELECT list_id, CAST(ntile(8) OVER (ORDER BY list_id) AS INT) AS block FROM lists")
def block_partition(f):
    size, extra, at = F.floor(_col("total") / 8), _col("total") % 8, _col("place") - 1
    wide = extra * (size + 1)
    block = F.when(at < wide, F.floor(at / (size + 1))).otherwise(extra + F.floor((at - wide) / F.greatest(size, F.lit(1))))
    return _numbered(f).select("list_id", (block + 1).cast("int").alias("block"))
