"""Prompts as arrays of (role, content) messages; wording is a parameter.

Templates hold the places {query}, {language} and {candidates}; ``TEMPLATES`` is a plain default set. Randomness of
order is a hash of the key, so a prompt is the same in every run.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gavelspark.functions import text as X

TEMPLATES = {
    "system": "You judge programs.",
    "select": "Task in {language}:\n{query}\n\n{candidates}\n\nPut the letter of the correct program into a box.",
    "pair_score": "Task in {language}:\n{query}\n\n{candidates}\n\nPut a list of two scores from 0 to 10 into a box.",
    "list_score": "Task in {language}:\n{query}\n\n{candidates}\n\nPut a list of one score from 0 to 10 per program into a box.",
    "functional": "Complete the function.\n{query}{starter}",
    "stdin": "Write a program that reads standard input.\n{query}{starter}",
}
OPEN_THINK = "<think>\n"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def fill(template: str | Column, **values: Column) -> Column:
    """The template with every {name} replaced; a null value becomes the empty text."""
    out = template if isinstance(template, Column) else F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def label_candidates(candidates: Column, n: Column, language: Column, letters: str = "ABCDE") -> Column:
    """Each of the first ``n`` candidates, fenced with its language, between labels with its letter, joined by a blank line; further ones than letters are left out."""
    shown = F.slice(candidates, F.lit(1), F.least(n, F.lit(len(letters))))

    def block(c: Column, i: Column) -> Column:
        mark = X.letter(i, letters)
        return F.concat(F.lit("[CANDIDATE_"), mark, F.lit("]\n```"), F.coalesce(language, F.lit("")), F.lit("\n"), F.coalesce(c, F.lit("")), F.lit("\n```\n[/CANDIDATE_"), mark, F.lit("]"))

    return F.array_join(F.transform(shown, block), "\n\n")


def build_prompt(query: Column, language: Column, candidates: Column, n: Column, model: str, templates: dict[str, str] = TEMPLATES) -> Column:
    """Messages for a judge whose name decides the form: instruct models get system and user, scoring models score, all but instruct models start to think."""
    name = "select" if "Instruct" in model or not ("lrm" in model or "grm" in model) else "pair_score" if "lrm" in model else "list_score"
    user = message("user", fill(templates[name], language=language, candidates=label_candidates(candidates, n, language), query=query))
    if "Instruct" in model:
        return F.array(message("system", F.lit(templates["system"])), user)
    return F.array(user, message("assistant", F.lit(OPEN_THINK)))


def build_prompt_train(query: Column, language: Column, candidates: Column, n: Column, thinking: bool, templates: dict[str, str] = TEMPLATES) -> Column:
    """Messages for training: thinking models are opened with a think tag, others get the system text."""
    return build_prompt(query, language, candidates, n, "plain" if thinking else "Instruct", templates)


def build_prompt_pair(query: Column, language: Column, chosen: Column, rejected: Column, key: Column, model: str, templates: dict[str, str] = TEMPLATES) -> Column:
    """Messages for a chosen and a rejected text; an even key puts the chosen one first; ``++`` in a language becomes ``pp``."""
    first = F.pmod(key, F.lit(2)) == 0
    both = F.array(F.when(first, chosen).otherwise(rejected), F.when(first, rejected).otherwise(chosen))
    lowered = model.lower()
    name = "Instruct" if "instruct" in lowered else "lrm" if "judge_lrm" in lowered else "grm" if "grm" in lowered else "plain"
    return build_prompt(query, F.replace(F.lower(language), F.lit("++"), F.lit("pp")), both, F.lit(2), name, templates)


def to_messages(c: Column, role: str) -> Column:
    """A plain text as one message."""
    return F.array(message(role, c))


def problem_meta(platform: Column, metadata: Column) -> Column:
    """(platform in lower case, whether tests call a function, its name): the name defaults to ``solve``, also for broken JSON."""
    low = F.lower(F.coalesce(platform, F.lit("")))
    name = F.coalesce(F.get_json_object(metadata, "$.func_name"), F.lit(""))
    return F.struct(low.alias("platform"), (low == "leetcode").alias("functional"), F.when(name == "", "solve").otherwise(name).alias("func_name"))


def build_codegen_prompt(query: Column, starter: Column, functional: Column, templates: dict[str, str] = TEMPLATES) -> Column:
    """One user message with the system text in front, by kind of problem, with the starter code if there is one."""
    block = F.when(F.coalesce(starter, F.lit("")) != "", F.concat(F.lit("\n"), starter))
    body = F.when(functional, fill(templates["functional"], starter=block, query=X.strip_html(query))).otherwise(fill(templates["stdin"], starter=block, query=X.strip_html(query)))
    return F.array(message("user", F.concat(F.lit(templates["system"] + "\n\n"), body)))


def _judge(query: Column, blocks: Column, template: str, scoring: bool, thinking: bool, templates: dict[str, str]) -> Column:
    user = message("user", fill(templates[template], language=F.lit("python"), candidates=blocks, query=X.strip_html(query)))
    if thinking:
        return F.array(user, message("assistant", F.lit(OPEN_THINK)))
    return F.array(user) if scoring else F.array(message("system", F.lit(templates["system"])), user)


def build_list_prompt(query: Column, candidates: Column, n: Column, scoring: bool, thinking: bool, templates: dict[str, str] = TEMPLATES) -> Column:
    """Messages for choosing among up to eight programs: thinking styles are opened, plain ones get the system text unless they score."""
    blocks = label_candidates(candidates, n, F.lit("python"), X.LETTERS)
    return _judge(query, blocks, "list_score" if scoring else "select", scoring, thinking, templates)


def build_pair_prompt(query: Column, code_a: Column, code_b: Column, scoring: bool, thinking: bool, templates: dict[str, str] = TEMPLATES) -> Column:
    """As ``build_list_prompt`` for two programs; scores are asked for in the form of lists."""
    blocks = label_candidates(F.array(code_a, code_b), F.lit(2), F.lit("python"))
    return _judge(query, blocks, "list_score" if scoring else "select", scoring, thinking, templates)


def pick_continuation(completions: Column, key: Column) -> Column:
    """One of the texts cut after their first box opener, chosen by the key; without any, one of the texts with an opener put behind it."""
    cut = F.filter(F.transform(completions, X.truncate_at_boxed), lambda x: x.isNotNull())
    choose = lambda a: F.get(a, F.pmod(key, F.size(a)).cast("int"))
    return F.when(F.size(cut) > 0, choose(cut)).when(F.size(completions) > 0, F.concat(F.coalesce(choose(completions), F.lit("None")), F.lit(X.BOX)))


def extend_messages(messages: Column, text: Column) -> Column:
    """The text put behind a trailing assistant message, or added as one."""
    last = F.try_element_at(messages, F.lit(-1))
    longer = F.array(F.struct(F.lit("assistant").alias("role"), F.concat(last["content"], text).alias("content")))
    kept = F.slice(messages, F.lit(1), F.greatest(F.size(messages) - 1, F.lit(0)))
    return F.when(last["role"] == "assistant", F.concat(kept, longer)).otherwise(F.concat(messages, F.array(F.struct(F.lit("assistant").alias("role"), text.alias("content")))))


def render_chat(messages: Column, bos: str, user: str, assistant: str, eos: str, generation_prompt: bool) -> Column:
    """One text: start mark, the last system message, then every other message behind its role mark; an empty ``eos`` leaves open turns."""
    system = F.try_element_at(F.filter(messages, lambda m: m["role"] == "system"), F.lit(-1))["content"]
    rest = F.filter(messages, lambda m: m["role"] != "system")
    part = lambda m: F.when(m["role"] == "user", F.concat(F.lit(user), m["content"])).otherwise(F.concat(F.lit(assistant), m["content"], F.lit(eos)))
    body = F.aggregate(rest, F.lit(""), lambda acc, m: F.concat(acc, part(m)))
    return F.concat(F.lit(bos), F.coalesce(system, F.lit("")), body, F.lit(assistant + OPEN_THINK if generation_prompt else ""))


def extract_option_answer(scores: Column, n: Column) -> Column:
    """Letter of the only best of exactly ``n`` scores, else ``Invalid``."""
    return F.coalesce(X.letter(X.top_index(scores, n)), F.lit("Invalid"))
