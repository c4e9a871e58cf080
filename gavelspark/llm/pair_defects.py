"""Problem 3: defective prompt and response pairs.

Each side gets at most one defect, the first that holds of: ``empty``, ``copy``, ``refusal``, ``truncated``,
``other_language``. The middle three need that no verdict (a chosen letter) is named.

* ``EndModel``: likelihood of the end of a text. Over all responses it counts the n-grams of characters in front of a
  lone letter, inside its sentence: how often at all, and how often in the last sentence of a text. An n-gram that
  mostly stands at the end is the wording of a verdict, in whatever language; a text without one breaks off.
  Longer n-grams fall back on shorter ones.
* ``WholeModel``: which pairs of words the responses that name a verdict use. A text without verdict that consists of
  such pairs is an answer that breaks off; one of other pairs does not answer at all: it refuses.
* Languages of question and answer are compared by posteriors of a naive Bayes model over character n-grams of
  words. It is fitted on a bounded sample of labelled texts (``SAMPLE`` rows).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelspark.llm import shingles as S
from gavelspark.session import materialize

#: Labelled texts for the language model, taken in order of a hash of the text; and the characters read of each are all.
SAMPLE = 3_000
NGRAM = 3
#: Log odds from which two languages count as different, for the question and for the answer.
LEAST_ODDS = 4.0
#: Share of an answer's shingles that stand in the prompt, and of the question's that stand in the answer, from which the answer is a copy.
COPY_OF_ANSWER, COPY_OF_QUESTION = 0.5, 0.5
#: Longest n-gram of the end model, weight of the next shorter one in occurrences, and least probability of an end.
END_CHARS, BACKOFF, END_PROBABILITY = 16, 1.0, 0.5
#: N-grams with less than this share of all lone letters are judged by their shorter ones; so at most END_CHARS / END_SHARE are held.
END_SHARE = 5e-5
#: Pairs of words on less than this share of the responses with a verdict count as unknown; so at most (pairs of an average response) / PAIR_SHARE are held.
PAIR_SHARE = 2e-4
#: Share of known pairs up to which a text is another kind of text than an answer, and least number of pairs to tell by what follows the thinking alone.
FOREIGN, LEAST_PAIRS = 0.35, 4

# Fillers for a missing value.
FILLERS = {"null", "none", "nil", "nan", "n/a", "na", "undefined", "empty", "tbd", "todo", "missing", "void", "no answer", "no response"}

_LETTER = r"[A-H]"
# Marks around a letter that make it a verdict in any text.
_MARKS = re.compile(rf"\\boxed\{{[\s\[\]*]*{_LETTER}[\s\[\]*]*\}}|\[\[\s*{_LETTER}\s*\]\]|\*\*\s*{_LETTER}\s*\.?\*\*|(?m:^\s*[(\"']?{_LETTER}[)\"'.]?\s*$)")
_LONE = re.compile(rf"(?<![A-Za-z0-9_\\]){_LETTER}(?![A-Za-z0-9_'’])")
_STOP = re.compile(r"[。！？]|[.!?](?:\s|$)|\n")
_CLOSED = re.compile(r"</\s*think\s*>", re.I)
_THINK = re.compile(r"</?\s*think\s*>", re.I)
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_TAG = re.compile(r"<[^<>\n]{0,80}>")
_BOX = re.compile(r"\\boxed\s*\{\s*\}|\\boxed")
_CANDIDATES = re.compile(r"\[CANDIDATE_[A-Z]\].*?(?:\[/CANDIDATE_[A-Z]\]|\Z)", re.S)
_IDENTIFIER = re.compile(r"\b\w*(?:_\w+|\d\w*|[a-z][A-Z]\w*)\b|`[^`\n]*`")
_INVISIBLE = regex.compile(r"[[\p{Cf}\p{Cc}\p{Cn}\p{Co}\u115f\u1160\u3164\uffa0\u2800]--\s]", regex.V1)
_PROSE_WORD = re.compile(r"[^\W\d_]+")
_PAIR_WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]|[[^\W\d_]--[\p{Han}\p{Hiragana}\p{Katakana}]]+", regex.V1)


def visible(text: str) -> str:
    """The text without control, format and other invisible characters (white space stays)."""
    return _INVISIBLE.sub("", text)


def is_empty(text: str | None) -> bool:
    if text is None:
        return True
    rest = visible(text)
    rest = _BOX.sub(" ", _TAG.sub(" ", _THINK.sub(" ", rest)))
    rest = re.sub(r"```\w*", " ", rest).strip().strip("\"'()[]{}*_#`.:;-–—…!? \n\t").lower()
    return rest in FILLERS or not any(c.isalnum() for c in rest)


def masked(text: str) -> str:
    """The text with identifiers and numbers replaced, so that wordings can be counted."""
    return re.sub(r"\d+", "0", _IDENTIFIER.sub("\x01", text))


def _tail(text: str, at: int) -> str:
    """What stands in front of a place, inside its sentence; a mark is the beginning of the sentence."""
    begin = max(0, at - 80)
    before = text[begin:at]
    start = max((m.end() for m in _STOP.finditer(before)), default=0)
    opening = "^" if start or not begin else ""
    return (opening + " ".join(masked(before[start:]).lower().split(" ")).lstrip())[-END_CHARS:]


def letter_tails(text: str) -> list[tuple[str, bool]]:
    """(n-gram in front of a lone letter, whether it stands in the last sentence of the text), closing marks aside."""
    text = _THINK.sub("\n", text).rstrip()
    last = max((m.end() for m in _STOP.finditer(text.rstrip(".!)]}*\"'。 \n"))), default=0)
    return [(_tail(text, m.start()), m.start() >= last) for m in _LONE.finditer(text)]


class EndModel:
    """Probability that an n-gram in front of a lone letter belongs to the last sentence; ``counts`` has (all, at the end)
    by n-gram, of the empty one those of all letters."""

    def __init__(self, counts: dict[str, tuple[int, int]]):
        self.counts = counts
        self._known: dict[str, float] = {}

    def probability(self, tail: str) -> float:
        found = self._known.get(tail)
        if found is None:
            if len(self._known) > 200_000:
                self._known.clear()
            found = 0.0
            for n in range(len(tail) + 1):
                held = self.counts.get(tail[len(tail) - n :])
                if held is None:
                    break
                found = (held[1] + BACKOFF * found) / (held[0] + BACKOFF)
            self._known[tail] = found
        return found

    def names_letter(self, text: str) -> bool:
        return bool(_MARKS.search(text)) or any(self.probability(tail) >= END_PROBABILITY for tail, _ in letter_tails(text))


def word_pairs(text: str) -> set[str]:
    """Pairs of neighbouring words inside the sentences of a text's prose; in scripts without blanks, of characters."""
    found: set[str] = set()
    for sentence in _STOP.split(_IDENTIFIER.sub(" ", _TAG.sub("\n", _FENCE.sub("\n", text)))):
        held = [w.lower() for w in _PAIR_WORD.findall(sentence)]
        found.update(f"{x} {y}" for x, y in zip(held, held[1:]))
    return found


class WholeModel:
    """The pairs of words that responses with a verdict use."""

    def __init__(self, pairs: set[str]):
        self.pairs = pairs

    def refuses(self, text: str) -> bool:
        """Whether a text without verdict consists of other pairs: the full sentences after the thinking, if they are long enough to tell."""
        parts = _CLOSED.split(text)
        ends = [m.end() for m in _STOP.finditer(parts[-1] + "\n" * parts[-1].rstrip().endswith((".", "!", "?")))]
        found = word_pairs(parts[-1][: max(ends, default=0)]) if len(parts) > 1 else set()
        found = found if len(found) >= LEAST_PAIRS else word_pairs(text)
        return bool(found) and len(found & self.pairs) <= FOREIGN * len(found)


def prose(text: str) -> list[str]:
    """Words of natural language: without code, identifiers and markup, in lower case."""
    rest = _IDENTIFIER.sub(" ", _BOX.sub(" ", _TAG.sub(" ", _CANDIDATES.sub(" ", _FENCE.sub(" ", text)))))
    return [w.lower() for w in _PROSE_WORD.findall(rest) if len(w) > 1 or not w.isascii()]


def grams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + NGRAM] for i in range(len(padded) - NGRAM + 1)]


class LanguageModel:
    """Naive Bayes over character n-grams of distinct words; ``odds`` are log posteriors less the best other one."""

    def __init__(self, counts: dict[str, Counter]):
        self.languages = sorted(counts)
        vocabulary = len(set().union(*counts.values())) if counts else 1
        self.logs = {}
        self.floor = {}
        for language in self.languages:
            total = sum(counts[language].values()) + 0.1 * vocabulary
            self.logs[language] = {g: math.log((n + 0.1) / total) for g, n in counts[language].items()}
            self.floor[language] = math.log(0.1 / total)
        self._words: dict[str, list[float]] = {}

    def _word(self, word: str) -> list[float]:
        found = self._words.get(word)
        if found is None:
            if len(self._words) > 200_000:
                self._words.clear()
            parts = grams(word)
            found = self._words[word] = [sum(self.logs[x].get(g, self.floor[x]) for g in parts) for x in self.languages]
        return found

    def scores(self, words: Iterable[str]) -> dict[str, float]:
        totals = [0.0] * len(self.languages)
        for word in set(words):
            for k, x in enumerate(self._word(word)):
                totals[k] += x
        return dict(zip(self.languages, totals))


def fit_languages(rows: Iterable[tuple[str, str]]) -> LanguageModel:
    """From (language, text). Labels may be wrong in places: after a first fit, texts are counted under the language that the model gives them."""
    held = [(language, prose(text)) for language, text in rows if language and text]
    for _ in range(2):
        counts: dict[str, Counter] = {}
        for language, found in held:
            counter = counts.setdefault(language, Counter())
            for word in set(found):
                counter.update(grams(word))
        model = LanguageModel(counts)
        held = [(max(scores, key=scores.get) if (scores := model.scores(found)) else language, found) for language, found in held]
    return model


def _differ(model: LanguageModel, question: dict[str, float], answer: str) -> bool:
    if len(model.languages) < 2:
        return False
    a, b = question, model.scores(prose(answer))
    asked, given = max(a, key=a.get), max(b, key=b.get)
    return asked != given and a[asked] - a[given] >= LEAST_ODDS and b[given] - b[asked] >= LEAST_ODDS


def question_of(prompt: str) -> str:
    return _CANDIDATES.sub(" ", prompt)


def is_copy(prompt: str, answer: str) -> bool:
    given = S.shingle_set(_THINK.sub(" ", answer))
    if not given:
        return False
    whole, question = S.shingle_set(prompt), S.shingle_set(question_of(prompt))
    return len(given & whole) >= COPY_OF_ANSWER * len(given) and (len(given & question) >= COPY_OF_QUESTION * max(1, len(question)) or len(given & whole) >= COPY_OF_QUESTION * len(whole))


def defects(prompt: str | None, answers: list[str | None], languages: LanguageModel, ends: EndModel, whole: WholeModel) -> list[str | None]:
    """The defect of each answer to one prompt, or None."""
    asked: dict[str, float] = {}
    out: list[str | None] = []
    for answer in answers:
        if is_empty(answer):
            out.append("empty")
            continue
        text = visible(answer)
        if not ends.names_letter(text):
            if prompt and is_copy(visible(prompt), text):
                out.append("copy")
            else:
                out.append("refusal" if whole.refuses(text) else "truncated")
            continue
        if prompt and not asked:
            asked = languages.scores(prose(question_of(visible(prompt))))
        out.append("other_language" if prompt and _differ(languages, asked, text) else None)
    return out


def end_model(responses: DataFrame) -> EndModel:
    """Counted over all responses (text), partially in the workers; END_SHARE bounds what reaches the driver."""

    def tails(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            every: Counter = Counter()
            ends: Counter = Counter()
            for text in f.text:
                for tail, end in letter_tails(visible(text)):
                    every[tail] += 1
                    ends[tail] += end
            yield pd.DataFrame({"tail": list(every), "n": list(every.values()), "ends": [ends[t] for t in every]})

    counted = responses.where("text is not null").select("text").mapInPandas(tails, "tail string, n long, ends long")
    counted = counted.groupBy("tail").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    suffixes = F.transform(F.sequence(F.lit(0), F.length("tail")), lambda n: F.right("tail", n))
    counted = materialize(counted.select(F.explode(suffixes).alias("tail"), "n", "ends").groupBy("tail").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")), "tails")
    total = (counted.where("tail = ''").agg(F.sum("n")).first()[0]) or 0
    rows = counted.where(F.col("n") >= END_SHARE * total).toArrow().to_pylist()
    return EndModel({r["tail"]: (r["n"], r["ends"]) for r in rows})


def whole_model(responses: DataFrame, ends) -> WholeModel:
    """Counted over all responses (text) that name a verdict by the (broadcast) end model; PAIR_SHARE bounds what reaches the driver."""

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            seen: Counter = Counter()
            for text in f.text:
                shown = visible(text)
                if ends.value.names_letter(shown):
                    seen.update(word_pairs(shown))
                    seen[""] += 1
            yield pd.DataFrame({"pair": list(seen), "n": list(seen.values())})

    counted = responses.where("text is not null").select("text").mapInPandas(pairs, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "pairs")
    total = (counted.where("pair = ''").agg(F.sum("n")).first()[0]) or 0
    return WholeModel(set(counted.where(F.col("n") >= PAIR_SHARE * total).where("pair <> ''").select("pair").toArrow()["pair"].to_pylist()))


def language_model(labelled: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Fitted on at most ``sample`` rows of (language, text), those with the smallest hash of the text."""
    known = labelled.select("language", "text").where("language is not null and trim(text) <> ''").withColumn("h", F.xxhash64("text"))
    # the bound is found on hashes alone, so that no task sends more texts than the sample has
    last = known.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    rows = known.where(F.col("h") <= F.lit(last)).orderBy("h", "language").limit(sample).collect() if last is not None else []
    return fit_languages([(r.language, r.text) for r in rows])


def pair_defects(pairs: DataFrame, labelled: DataFrame) -> DataFrame:
    """(pair_id, side, defect) of each defective side of pairs (pair_id, prompt, chosen, rejected).

    A pair delivered several times counts once; if deliveries differ in their defects, each side takes the defect
    that comes first by name. Rows without pair_id count one by one and come out with a null id. A null prompt
    cannot be copied and has no language. Without labelled texts no language is judged; an empty table gives no
    rows; other columns are not read. Only the defects found are shuffled.
    """
    responses = pairs.select(F.explode(F.array("chosen", "rejected")).alias("text"))
    sc = pairs.sparkSession.sparkContext
    ends_only = sc.broadcast(end_model(responses))
    sent = sc.broadcast((language_model(labelled), ends_only.value, whole_model(responses, ends_only)))
    id_type = pairs.schema["pair_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        languages, ends, whole = sent.value
        text = lambda x: x if isinstance(x, str) else None
        for f in frames:
            rows = []
            for pair, prompt, chosen, rejected in zip(f.pair_id, f.prompt, f.chosen, f.rejected):
                for side, found in zip(("chosen", "rejected"), defects(text(prompt), [text(chosen), text(rejected)], languages, ends, whole)):
                    if found:
                        rows.append((pair, side, found))
            yield pd.DataFrame(rows, columns=["pair_id", "side", "defect"])

    found = pairs.select("pair_id", "prompt", "chosen", "rejected").mapInPandas(run, f"pair_id {id_type}, side string, defect string")
    alone = F.when(F.col("pair_id").isNull(), F.monotonically_increasing_id())
    return found.groupBy("pair_id", alone.alias("alone"), "side").agg(F.min("defect").alias("defect")).drop("alone")
