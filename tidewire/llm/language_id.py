"""Language identification by cross-parsing entropy.

For each language a suffix automaton accepts every substring of some labelled text. A
text is parsed against it into longest matches: a phrase goes on as long as the
automaton does, and the next one starts at the letter that it did not have. The fewer
phrases, each at the cost of naming a place in the labelled text, the closer the text is
to the language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.llm import text as tw
from tidewire.llm.cluster import cut

#: Language of a text without a letter.
UNKNOWN = "und"
#: Symbols of a block; blocks are parsed side by side, and phrases run on over their ends.
BLOCK = 256
#: Symbol classes: end of a block's text, anything between words, letters that no language has.
PAD, GAP, OTHER = 0, 1, 2


def automaton(symbols: list[int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Transitions of the suffix automaton of `symbols`, 0 for none, and those by rare symbols.

    The first is state by symbol to state, for symbols below `width`; the second has rows
    (state, symbol, next state) for the others. State 1 is the root. Padding leaves a state
    as it is.
    """
    link, length, moves = [0, 0], [0, 0], [{}, {}]
    last = 1
    for symbol in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(1)
        at = last
        while at and symbol not in moves[at]:
            moves[at][symbol] = new
            at = link[at]
        if at:
            after = moves[at][symbol]
            if length[after] == length[at] + 1:
                link[new] = after
            else:
                twin = len(moves)
                moves.append(dict(moves[after]))
                length.append(length[at] + 1)
                link.append(link[after])
                link[after] = link[new] = twin
                while at and moves[at].get(symbol) == after:
                    moves[at][symbol] = twin
                    at = link[at]
        last = new
    table, rare = np.zeros((len(moves), width), np.int32), []
    for state, own in enumerate(moves):
        for symbol, after in own.items():
            if symbol < width:
                table[state, symbol] = after
            else:
                rare.append((state, symbol, after))
    table[:, PAD] = np.arange(len(moves))
    return table, np.array(rare, np.int64).reshape(-1, 3)


@dataclass(frozen=True)
class Reference:
    """Labelled text by language, in order of language."""

    texts: tuple[tuple[str, str], ...]


class Parser:
    """Parses batches of texts against the automata of all languages at once.

    Every letter of the references has a symbol of its own. Transitions by the `dense` commonest
    ones are a table, the others a sorted list.
    """

    def __init__(self, reference: Reference, dense: int = 48):
        self.languages = [name for name, _ in reference.texts]
        codes = [self._codes(text.lower()) for _, text in reference.texts]
        alphabetic = np.array([chr(i).isalpha() for i in range(0x110000)])
        letters, n = np.unique(np.concatenate([c[alphabetic[c]] for c in codes]), return_counts=True)
        kept = letters[np.argsort(-n, kind="stable")]
        self.classes = np.full(0x110000, GAP, np.int32)
        self.classes[alphabetic] = OTHER
        self.classes[kept] = np.arange(3, 3 + len(kept))
        self.symbols = 3 + len(kept)
        self.width = min(self.symbols, 3 + dense)
        tables, keys, targets, base = [], [], [], 0
        self.roots, self.bits = [], []
        for code in codes:
            symbols = self.classes[code]
            symbols = symbols[(symbols != GAP) | (np.roll(symbols, 1) != GAP)]
            table, rare = automaton(symbols.tolist(), self.width)
            self.bits.append(np.log2(max(2, len(symbols))))
            # States of all languages in one table; those without a transition stay 0.
            tables.append(np.where(table > 0, table + base, 0).astype(np.int32))
            keys.append((rare[:, 0] + base) * self.symbols + rare[:, 1])
            targets.append(rare[:, 2] + base)
            self.roots.append(base + 1)
            base += len(table)
        self.table = np.concatenate(tables)
        self.table[0] = 0
        key, target = np.concatenate(keys), np.concatenate(targets)
        order = np.argsort(key)
        # A last key that no symbol has, so that every search ends in the list.
        self.rare = np.append(key[order], np.iinfo(np.int64).max)
        self.rare_next = np.append(target[order], 0).astype(np.int32)
        #: The state that a phrase is in after its first symbol: the root, if the language lacks it.
        every = np.arange(self.symbols)
        first = np.stack([self.move(np.full(self.symbols, r, np.int32), every) for r in self.roots])
        self.first = np.where(first > 0, first, np.array(self.roots)[:, None]).astype(np.int32)

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

    def move(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states after one symbol each, 0 where the automaton has no transition."""
        common = symbol < self.width
        if common.all():
            return self.table.ravel().take(state * np.int64(self.width) + symbol)
        after = self.table.ravel().take(state * np.int64(self.width) + np.where(common, symbol, 0))
        key = state[~common] * np.int64(self.symbols) + symbol[~common]
        at = np.searchsorted(self.rare, key)
        after[~common] = np.where(self.rare[at] == key, self.rare_next[at], 0)
        return after

    def symbols_of(self, text: str) -> np.ndarray:
        """Classes of a text's characters; neighbouring gaps are one."""
        own = self.classes[self._codes(text.lower())]
        return own[(own != GAP) | (np.concatenate([[GAP], own[:-1]]) != GAP)] if len(own) else own

    def phrases(self, symbols: list[np.ndarray]) -> np.ndarray:
        """How many longest matches each language needs for each text: language by text.

        All blocks are parsed at once, as if each began a phrase. Then what a block's end leaves
        open goes on into the next one, until the parse is where that block's own was; a parse
        that is still apart at the block's end is carried into the one after it.
        """
        size = np.array([len(x) for x in symbols], np.int64)
        blocks = -(-size // BLOCK)
        padded = np.zeros(int(blocks.sum()) * BLOCK, np.int32)
        at = np.repeat((np.cumsum(blocks) - blocks) * BLOCK - (np.cumsum(size) - size), size) + np.arange(size.sum())
        padded[at] = np.concatenate(symbols) if symbols else padded[:0]
        steps = np.ascontiguousarray(padded.reshape(-1, BLOCK).T)
        k, lanes = len(self.languages), steps.shape[1]
        owner = np.repeat(np.arange(len(symbols)), blocks)
        opens = np.ones(lanes, bool)
        opens[1:] = owner[1:] != owner[:-1]
        states, fails = np.zeros((BLOCK, k * lanes), np.int32), np.zeros((BLOCK, k * lanes), bool)
        language = np.repeat(np.arange(k), lanes)
        state = np.repeat(np.array(self.roots, np.int32), lanes)
        for t, step in enumerate(steps):
            after = self.move(state, np.tile(step, k))
            fails[t] = after == 0
            state = states[t] = np.where(fails[t], self.first[:, step].ravel(), after)
        going = np.flatnonzero(np.tile(~opens, k))
        while len(going):
            lane, state = going, states[-1, going - 1].copy()
            apart = []
            for t in range(BLOCK):
                symbol = steps[t, lane % lanes]
                after = self.move(state, symbol)
                failed = after == 0
                state = np.where(failed, self.first[language[lane], symbol], after)
                differs = state != states[t, lane]
                fails[t, lane], states[t, lane] = failed, state
                lane, state = lane[differs], state[differs]
                if not len(lane):
                    break
            else:
                apart = lane + 1
                apart = apart[(apart < k * lanes)]
                apart = apart[~opens[apart % lanes]]
            going = np.asarray(apart, np.int64)
        counts = fails.sum(0).reshape(k, lanes)
        return 1 + np.stack([np.bincount(owner, c, minlength=len(symbols)) for c in counts]).astype(np.int64)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float | None]]:
        """Language, score and bits a letter of each text."""
        symbols = [self.symbols_of(t or "") for t in texts]
        phrases = self.phrases(symbols)
        bits = phrases * np.array(self.bits)[:, None] / np.maximum([len(x) for x in symbols], 1)
        languages, scores, least = [], [], []
        for i, own in enumerate(symbols):
            if not (own > GAP).any():
                languages.append(UNKNOWN)
                scores.append(0.0)
                least.append(None)
                continue
            best = int(np.argmin(bits[:, i]))
            # Phrases that each language needs over the best one, as odds against it.
            over = (bits[:, i] - bits[best, i]) / bits[best, i] * phrases[best, i]
            languages.append(self.languages[best])
            scores.append(float(1 / np.exp(-np.minimum(over, 700)).sum()))
            least.append(float(bits[best, i]))
        return languages, scores, least


def reference(
    frame: DataFrame, labelled: Column, id_col: str, text_col: str, lang_col: str, most_rows: int, most_letters: int, most_total: int
) -> Reference:
    """Labelled text of each language: at most `most_rows` rows and `most_letters` characters.

    All languages together have at most `most_total` characters. Rows come by a hash of
    their id, so that reruns agree, and each gives as many characters as every other may.
    Texts are cut before they reach the driver, which holds that many characters at most.
    """
    rows = frame.where(labelled & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    order = W.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    picked = rows.withColumn("n", F.dense_rank().over(order)).where(F.col("n") <= most_rows)
    picked = cut(picked.groupBy("id", "lang").agg(F.min("n").alias("n")))
    n_languages = max(1, picked.select("lang").distinct().count())
    letters = min(most_letters, most_total // n_languages)
    each = picked.groupBy("lang").agg(F.greatest(F.lit(1), F.floor(F.lit(letters) / F.count("*"))).cast("int").alias("each"))
    ids = F.broadcast(picked.join(each, "lang"))
    texts = frame.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    cut_texts = texts.join(ids, ["id", "lang"]).select("id", "lang", "n", F.expr("substring(text, 1, each)").alias("text"))
    found: dict[str, list[tuple[int, str]]] = {}
    for row in cut_texts.groupBy("id", "lang", "n").agg(F.min("text").alias("text")).collect():
        found.setdefault(row["lang"], []).append((row["n"], row["text"] or ""))
    return Reference(tuple((k, " ".join(t for _, t in sorted(v))) for k, v in sorted(found.items())))


#: A worker process's parsers, by reference text: built once, not once a task.
_parsers: dict[Reference, Parser] = {}


def identify(
    frame: DataFrame,
    labelled: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    most_rows: int = 400,
    most_letters: int = 60_000,
    most_total: int = 480_000,
) -> DataFrame:
    """(id, lang_pred, score, bits) of each row of `frame`.

    Languages and their text are learned from rows where `labelled` holds, the language is
    not null and the text has a letter; predictions look at the text alone. `bits` are
    those a letter against the language, `score` the odds of the phrases it saves turned
    into a probability. A text that is null or has no letter (Unicode category L) is `und`
    with score 0, and so is every text where no language could be learned. Ties go to the
    first language by code point. Null ids and repeated rows stay (an id teaches once), an
    empty table gives no rows; texts are parsed whole, however long; other columns are left out.

    Learned text is bounded: `most_rows` rows of a language give up to `most_letters`
    characters together, from each row's beginning, and all languages `most_total`, so with
    more than `most_total / most_letters` languages each has less. All letters of that text
    count, whatever the script; other letters match nothing.
    """
    shared = frame.sparkSession.sparkContext.broadcast(
        reference(frame, labelled, id_col, text_col, lang_col, most_rows, most_letters, most_total)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        if known.texts and known not in _parsers:
            _parsers.clear()
            _parsers[known] = Parser(known)
        for whole in batches:
            for batch in tw.slices(whole, "text", 1_000_000):
                texts = batch.column(1).to_pylist()
                found = _parsers[known].predict(texts) if known.texts else ([UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts))
                columns = [pa.array(c, k) for c, k in zip(found, (pa.string(), pa.float64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "lang_pred", "score", "bits"])

    rows = frame.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, bits double")
