"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text accepts exactly the
substrings of that text. A document is parsed greedily into the longest phrases
that an automaton accepts; the language that needs the fewest phrases per
character wins.

Learning takes a bounded sample of labelled rows (``sample_docs`` documents and
``sample_chars`` characters a language, both parameters). Parsing covers whole
texts and phrases end nowhere else: a batch is cut into strips of ``STRIP``
characters that all step through an automaton at the same time, each as if a
text began there. Strips are then parsed again from the state in which the strip
before them ended, only until they meet their first parse (most do within a
phrase or two), and so on until no end changes.

Automata are kept as packed rows: the steps of a state lie where its place and
the symbol add up, in gaps that other states leave. Their size grows with the
characters learned from, not with the letters of a language.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import slices

UNKNOWN = "und"
STRIP = 512
#: characters that are parsed at once
BATCH = 1 << 20
#: labelled documents and characters of each that a language learns from, and characters in all
SAMPLE_DOCS, SAMPLE_DOC_CHARS, SAMPLE_CHARS = 100, 300, 25_000
#: characters over all languages; many languages share it
TOTAL_CHARS = 300_000
#: languages that a model learns at most, the most frequent ones
MAX_LANGUAGES = 1000


def fold(text: str, after_letter: bool = False) -> np.ndarray:
    """Code points of the lower-cased text; all but letters are one space each run, none at the begin.

    ``after_letter`` tells that the text goes on behind a letter.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(points < len(_LETTER), points, 0xFFFF)
    letters = np.where(_LETTER[points], points, 32)
    keep = letters != 32
    keep[:1] |= after_letter
    keep[1:] |= letters[:-1] != 32
    return letters[keep]


def _letters() -> np.ndarray:
    table = np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000)
    table[0xFFFF] = True  # stands for letters beyond the basic plane
    return table


_LETTER = _letters()


def has_letter(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))


def lettered(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring."""
    after: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        state = len(after)
        after.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in after[p]:
            after[p][c] = state
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                clone = len(after)
                after.append(dict(after[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = clone
                    p = link[p]
                link[q] = link[state] = clone
        last = state
    return after


def _packed_rows(after: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of each state's row, and owner and next state of each slot.

    A step of a state with symbol c is in slot ``place + c``. Places are tried at
    random, in rounds for all states that have none, states with many steps
    first; no two states share a place, so a slot's owner tells whose it is.
    """
    degree = np.fromiter(map(len, after), np.int64, len(after))
    state_of = np.repeat(np.arange(len(after)), degree)
    symbol = np.fromiter((c for edges in after for c in edges), np.int64, int(degree.sum()))
    to = np.fromiter((t for edges in after for t in edges.values()), np.int32, len(symbol))
    room = 3 * len(symbol) + len(after)
    owner = np.full(room + width, -1, np.int32)
    target = np.zeros(room + width, np.int32)
    place = np.full(len(after), -1, np.int64)
    taken = np.zeros(room, bool)
    begin = np.concatenate([[0], np.cumsum(degree)])
    rng = np.random.default_rng(1)
    # large rows one by one into a nearly empty table, the first one at 0
    large = [s for s in np.argsort(-degree, kind="stable").tolist() if degree[s] > 8]
    for s in large:
        edges = slice(begin[s], begin[s + 1])
        at = 0
        while taken[at] or (owner[at + symbol[edges]] >= 0).any():
            at = int(rng.integers(room))
        place[s], taken[at] = at, True
        owner[at + symbol[edges]], target[at + symbol[edges]] = s, to[edges]
    while (place < 0).any():
        edges = np.flatnonzero(place[state_of] < 0)
        states = np.flatnonzero(place < 0)
        tried = np.zeros(len(after), np.int64)
        tried[states] = rng.integers(room, size=len(states))
        slots = tried[state_of[edges]] + symbol[edges]
        fails = np.zeros(len(after), bool)
        fails[states[taken[tried[states]]]] = True
        fails[state_of[edges[owner[slots] >= 0]]] = True
        # of states that want the same place or slot in this round, the first has it
        for wanted, who in ((tried[states], states), (slots, state_of[edges])):
            order = np.argsort(wanted, kind="stable")
            again = np.zeros(len(order), bool)
            again[1:] = wanted[order][1:] == wanted[order][:-1]
            fails[who[order[again]]] = True
        place[states] = np.where(fails[states], -1, tried[states])
        taken[tried[states[~fails[states]]]] = True
        won = ~fails[state_of[edges]]
        owner[slots[won]], target[slots[won]] = state_of[edges[won]], to[edges[won]]
    return place, owner, target


class _Automaton:
    """Packed steps of one language.

    States are named by their places. A step that a state lacks begins a new
    phrase with the root's step; where the root has none either, and before a
    text, the state is ``start``, which owns no slot.
    """

    def __init__(self, after: list[dict[int, int]], width: int) -> None:
        place, owner, target = _packed_rows(after, width)
        self.start = len(owner) - width + 1  # beyond all places; its slots belong to nobody
        self.owner = np.concatenate([np.where(owner >= 0, place[owner], -1), np.full(width, -1)]).astype(np.int32)
        self.target = np.concatenate([place[target], np.zeros(width)]).astype(np.int32)
        self.root = np.full(width, self.start, np.int32)
        for c, to in after[0].items():
            self.root[c] = place[to]

    def step(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states, and where a new phrase begins."""
        slots = states + symbols
        fresh = self.owner.take(slots) != states
        return np.where(fresh, self.root.take(symbols), self.target.take(slots)), fresh


class LanguageModel:
    """One automaton for each language, over one numbering of letters.

    Symbol 0 is padding; symbol 1 is every character that no language has seen.
    """

    def __init__(self, samples: dict[str, list[str]], total_chars: int = TOTAL_CHARS) -> None:
        self.languages = sorted(samples)
        share = max(1, total_chars // max(1, len(self.languages)))
        texts = {
            lang: np.concatenate([fold(t + " ") for t in parts])[:share] if parts else np.zeros(0, np.uint32)
            for lang, parts in samples.items()
        }
        seen = np.unique(np.concatenate([*texts.values(), np.zeros(0, np.uint32)])).astype(np.int64)
        width = len(seen) + 2
        self.symbol = np.ones(0x10000, np.int32)
        self.symbol[seen] = np.arange(len(seen), dtype=np.int32) + 2
        self.automata = [
            _Automaton(suffix_automaton(self.symbol[texts[lang]].tolist()), width) for lang in self.languages
        ]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrase counts: one row per text, one column per language."""
        counts = np.zeros((len(texts), len(self.languages)), np.int64)
        ends = [a.start for a in self.automata]
        parts: list[np.ndarray] = []
        owners: list[int] = []
        held = 0
        for i, text in enumerate(texts):
            after_letter = False
            for begin in range(0, len(text), BATCH):
                folded = fold(text[begin : begin + BATCH], after_letter)
                after_letter = bool(len(folded)) and folded[-1] != 32
                parts.append(self.symbol[folded])
                owners.append(i)
                held += len(folded)
                if held >= BATCH:
                    ends = self._parse(parts, owners, ends, counts)
                    if begin + BATCH >= len(text):  # else the text goes on from where it is
                        ends = [a.start for a in self.automata]
                    parts, owners, held = [], [], 0
        if parts:
            self._parse(parts, owners, ends, counts)
        return counts

    def _parse(self, parts: list[np.ndarray], owners: list[int], begins: list[int], counts: np.ndarray) -> list[int]:
        """Add the phrases of ``parts`` to the rows ``owners`` of ``counts``.

        The first part goes on in the states ``begins``, a part of the same owner
        as the one before goes on behind it. Returns the states in which the last
        part ends.
        """
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        strips = -(-sizes // STRIP)
        part_of = np.repeat(np.arange(len(parts)), strips)
        if not len(part_of):
            return begins
        flat = np.zeros(len(part_of) * STRIP, np.int32)
        at = 0
        for part, n in zip(parts, strips.tolist(), strict=True):
            flat[at : at + len(part)] = part
            at += n * STRIP
        number = np.arange(len(part_of)) - np.repeat(np.cumsum(strips) - strips, strips)
        used = np.minimum(sizes[part_of] - number * STRIP, STRIP)
        symbols = np.ascontiguousarray(flat.reshape(-1, STRIP).T)
        row_of = np.asarray(owners)[part_of]
        goes_on = np.flatnonzero(row_of[1:] == row_of[:-1]) + 1
        order = np.argsort(-used, kind="stable")  # full strips first: short ones drop out
        live = np.searchsorted(-used[order], -np.arange(STRIP), side="left")
        columns = np.ascontiguousarray(symbols[:, order])
        result = []
        for language, automaton in enumerate(self.automata):
            start = np.full(len(order), automaton.start, np.int32)
            start[0] = begins[language]
            states = np.empty((STRIP, len(order)), np.int32)
            fresh = np.zeros((STRIP, len(order)), bool)
            now = start[order]
            for step in range(int(used.max())):
                n = live[step]
                now[:n], fresh[step, :n] = automaton.step(now[:n], columns[step, :n])
                states[step] = now
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            ends = now[back]
            again = goes_on
            while len(again):
                again = again[ends[again - 1] != start[again]]
                start[again] = ends[again - 1]
                before = ends[again].copy()
                now, todo = start[again], np.arange(len(again))
                for step in range(STRIP):
                    todo = todo[used[again[todo]] > step]
                    if not len(todo):
                        break
                    at = back[again[todo]]
                    new, begun = automaton.step(now[todo], symbols[step, again[todo]])
                    met = states[step, at] == new
                    states[step, at], fresh[step, at] = new, begun
                    now[todo] = ends[again[todo]] = new
                    # what follows is as in the parse before: its end stands
                    ends[again[todo[met]]] = before[todo[met]]
                    todo = todo[~met]
                changed = again[ends[again] != before] + 1
                again = changed[np.isin(changed, goes_on)]
            counts[:, language] += np.bincount(
                row_of[order], weights=fresh.sum(axis=0), minlength=len(counts)
            ).astype(np.int64)
            result.append(int(ends[-1]))
        return result

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; the score is how much clearer than the runner-up."""
        told = [i for i, t in enumerate(texts) if lettered(t)]
        languages, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not told or not self.languages:
            return languages, scores
        counts = self.phrases([texts[i] for i in told])
        ranked = np.sort(counts, axis=1)
        least = ranked[:, 0].astype(float)
        second = ranked[:, 1].astype(float) if ranked.shape[1] > 1 else np.inf
        score = 1.0 - least / (least + second)
        for i, best, s in zip(told, counts.argmin(axis=1).tolist(), score.tolist(), strict=True):
            languages[i], scores[i] = self.languages[best], s
        return languages, scores


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds == 0, F.lit(False))


def learn(
    labelled: DataFrame,
    sample_docs: int = SAMPLE_DOCS,
    doc_chars: int = SAMPLE_DOC_CHARS,
    sample_chars: int = SAMPLE_CHARS,
) -> LanguageModel:
    """Fit on a bounded sample of ``labelled(text, lang, key)``.

    About ``sample_docs`` documents of each language are drawn by the hash of
    ``key``, and of each a stretch of ``doc_chars`` characters from its middle,
    ``sample_chars`` in all. Rows without lang or without a letter teach nothing.
    """
    rows = labelled.where(F.col("lang").isNotNull() & has_letter(F.col("text")))
    draw = F.pmod(F.xxhash64("key"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    counts = (
        rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(MAX_LANGUAGES)
    )
    begin = F.greatest(F.lit(1), F.floor((F.length("text") - doc_chars) / 2).cast("int"))
    # twice as many are drawn as are kept, so that few languages fall short
    drawn = (
        rows.select("lang", draw.alias("draw"), F.col("text").substr(begin, F.lit(doc_chars)).alias("part"))
        # at most MAX_LANGUAGES rows; texts that are not drawn are not shuffled
        .join(F.broadcast(counts), "lang")
        .where(F.col("draw") * F.col("n") < 2 * sample_docs + 8)
    )
    sample: pd.DataFrame = drawn.select("lang", "draw", "part").toPandas().sort_values(["lang", "draw", "part"])
    texts: dict[str, list[str]] = {}
    for lang, part in zip(sample["lang"], sample["part"], strict=True):
        kept = texts.setdefault(lang, [])
        if len(kept) < sample_docs and sum(map(len, kept)) < sample_chars:
            kept.append(part)
    return LanguageModel(texts)


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs(doc_id, text)``.

    Only the text is an input. Null texts and texts without a letter give
    ``und`` and 0. Ties go to the first language in code point order. Rows are
    independent; other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by TOTAL_CHARS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            languages, scores = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(languages, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_struct(model: LanguageModel, spark: SparkSession) -> Callable[[Column], Column]:
    """The prediction as a function of a text column: a struct of ``lang_pred``, ``score`` and ``lettered``.

    ``lettered`` tells whether the text has a letter, whatever the model has learned.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, lettered boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        given = texts.tolist()
        languages, scores = shared.value.predict(given)
        return pd.DataFrame({"lang_pred": languages, "score": scores, "lettered": list(map(lettered, given))})

    return predict


def learn_from(docs: DataFrame) -> LanguageModel:
    """Learn from the rows of ``docs(doc_id, text, lang)`` outside the held-out fold."""
    labelled = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return learn(labelled.select("text", "lang", F.col("doc_id").alias("key")))


def identify(docs: DataFrame) -> DataFrame:
    """Learn on rows outside the held-out fold, predict every row.

    Returns ``doc_id, held_out, lang_pred, score``. A null doc_id is in no fold
    and teaches nothing. Without any labelled row everything is ``und``.
    """
    predicted = predict_languages(docs, learn_from(docs))
    return predicted.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
