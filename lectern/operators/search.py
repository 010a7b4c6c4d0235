"""Keyword search over a corpus of chunks, for many questions at once.

A corpus row is ``(chunk_id, ord, document_title, section, article, content)``; ``ord`` is unique and
breaks ties. A chunk is read once for a whole block of questions: the words of many chunks at a time
are looked up, and an automaton of the keywords reads only words that a task has not met.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, count, islice, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from lectern import vocab
from lectern.functions import text as tx
from lectern.operators.chunking import section_code
from lectern.session import cut_lineage

# Questions and keywords that go to the tasks at once, and questions that a task compares with some chunks at a time.
QUESTION_BLOCK = 32_768
QUESTION_SLICE = 4_096
KEYWORD_BLOCK = 50_000
# Rows of one Arrow batch that a task hands on, and chunks whose names a task keeps before it drops those cut.
ROWS_OUT = 20_000
KNOWN_CHUNKS = 20_000
# Characters and cells (chunks by terms, or by questions) that a task takes at once, and words that it remembers.
CHARS_AT_ONCE = 1_000_000
CELLS_AT_ONCE = 1_000_000
KNOWN_WORDS = 200_000
# Pairs of a question and a chunk that a task scores in full at once.
PAIRS_AT_ONCE = 200_000
# Terms that are looked for one by one; more of them make an automaton.
FEW_TERMS = 16
# Terms of many questions and chunks whose scores are summed as a matrix product.
COMMON_TERMS = 256
# Single-precision sums of scores may be off by these, as a share and in points; no score above zero is under a point.
SCORE_SHARE, SCORE_SLACK, LEAST_SCORE = 1e-4, 1e-2, 0.5


def _count_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Postings of each chunk, handed on as soon as there are ``ROWS_OUT`` of them."""
    rows: list[tuple] = []
    for batch in batches:
        for chunk, tokens in zip(batch["chunk_id"], batch["tokens"]):
            if tokens is not None:
                rows += [(chunk, token, tf) for token, tf in Counter(tokens).items()]
            if len(rows) >= ROWS_OUT:
                yield pd.DataFrame(rows, columns=["chunk_id", "token", "tf"])
                rows = []
    if rows:
        yield pd.DataFrame(rows, columns=["chunk_id", "token", "tf"])


def token_postings(corpus: DataFrame) -> DataFrame:
    """Inverted index: term frequency of every ASCII token in every chunk, counted where the chunk lies."""
    kind = dict(corpus.dtypes)["chunk_id"]
    tokens = corpus.select("chunk_id", tx.tokens("content").alias("tokens"))
    return tokens.mapInPandas(_count_tokens, f"chunk_id {kind}, token string, tf long")


def elements(df: DataFrame, keys: list[str], array: Column | str, name: str) -> DataFrame:
    """One row per non-null array element.

    The outer form keeps the optimizer from testing the array for emptiness first, which would compute
    a derived array twice.
    """
    return df.select(*keys, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def question_keywords(parsed: DataFrame) -> DataFrame:
    return elements(parsed, ["query_id"], "keywords", "keyword")


def inverse_frequency(documents: Column, matches: Column) -> Column:
    return F.log(F.lit(1.0) + (documents - matches + F.lit(0.5)) / (matches + F.lit(0.5)))


def blocks_of(df: DataFrame, key: str, size: int) -> Iterator[list[Row]]:
    """Rows of a table in hashed blocks of about ``size``, one at a time on the driver."""
    blocks = max(1, -(-df.count() // size))
    for block in range(blocks):
        rows = df.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == block).collect()
        if rows:
            yield rows


class Terms:
    """The terms of a list that a text contains, anywhere in it."""

    def __init__(self, terms: Sequence[str]):
        import ahocorasick

        self.terms = [(number, term) for number, term in enumerate(terms) if term]
        self.found = ahocorasick.Automaton()
        for number, term in self.terms:
            self.found.add_word(term, number)
        if len(self.found):
            self.found.make_automaton()

    def within(self, text: str | None) -> list[int]:
        if not text or not self.terms:
            return []
        if len(self.terms) <= FEW_TERMS:
            return [number for number, term in self.terms if term in text]
        return sorted({number for _, number in self.found.iter(text)})


class Lists:
    """Lists of numbers, one after the other in one array."""

    def __init__(self, lengths: np.ndarray, values: np.ndarray):
        self.lengths, self.values = lengths, values
        self.starts = np.cumsum(lengths) - lengths

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of ``which``: for every value the place in ``which``, and its place among the values."""
        lengths = self.lengths[which]
        owner = np.repeat(np.arange(len(which)), lengths)
        shift = self.starts[which] - (np.cumsum(lengths) - lengths)
        return owner, np.arange(len(owner)) + shift[owner]

    def extended(self, lengths: np.ndarray, values: np.ndarray) -> Lists:
        return Lists(np.append(self.lengths, lengths), np.append(self.values, values))


def whole_numbers(values: Iterable[int]) -> np.ndarray:
    return np.fromiter(values, dtype=np.int64)


def _none() -> Lists:
    return Lists(whole_numbers([]), whole_numbers([]))


class Words:
    """The terms and tokens of many texts, found once a word.

    A term without white space lies within one word of a text, and so does a token. Terms with white space are looked
    for in whole texts.
    """

    #: Bytes of tokens stay, line breaks part words, all else is blank.
    TOKEN_BYTES = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789\n" else 32 for c in range(256))

    def __init__(self, terms: Sequence[str]):
        self.size = len(terms)
        self.inner = Terms([term if term.split() == [term] else "" for term in terms])
        self.spaced = Terms(["" if term.split() == [term] else term for term in terms])
        self.place = {term.encode(): number for number, term in enumerate(terms) if term}
        self.forget()

    def forget(self) -> None:
        # Words are numbered as they are met.
        self.numbers = defaultdict(count().__next__)
        self.held, self.equal, self.tokens = _none(), _none(), np.zeros(0, dtype=np.int64)

    def learn(self, words: list[str]) -> None:
        """Terms within each new word, its tokens that are terms, and their number."""
        joined = "\n".join(words)
        hits = whole_numbers(chain.from_iterable(self.inner.found.iter(joined) if self.inner.terms else [])).reshape(-1, 2)
        word = np.searchsorted(np.cumsum(whole_numbers(map(len, words)) + 1), hits[:, 0], side="right")
        self.held = self.held.extended(np.bincount(word, minlength=len(words)), hits[:, 1])
        plain = joined.encode().translate(self.TOKEN_BYTES)
        data = np.frombuffer(plain, dtype=np.uint8)
        token = data > 32
        starts = np.flatnonzero(token & ~np.append(False, token[:-1]))
        word = np.cumsum(data == 10)[starts]
        self.tokens = np.append(self.tokens, np.bincount(word, minlength=len(words)))
        number = whole_numbers(map(self.place.get, plain.split(), repeat(-1)))
        self.equal = self.equal.extended(np.bincount(word[number >= 0], minlength=len(words)), number[number >= 0])

    def of(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(contained, counted, counts, lengths)`` of texts.

        Cells are ``text * terms + term``, in order: those where the text contains the term, and those where it has the
        term as a token, with how often. ``lengths`` are the texts' numbers of tokens.
        """
        if len(self.numbers) > KNOWN_WORDS:
            self.forget()
        known = len(self.numbers)
        # A word is looked up once a text, however often it is there.
        split = [Counter(text.split()) if text else {} for text in texts]
        word = whole_numbers(map(self.numbers.__getitem__, chain.from_iterable(split)))
        times = whole_numbers(chain.from_iterable(words.values() for words in split))
        if len(self.numbers) > known:
            self.learn(list(islice(self.numbers, known, None)))
        row = np.repeat(np.arange(len(texts)), [len(words) for words in split])
        lengths = np.bincount(row, weights=self.tokens[word] * times, minlength=len(texts)).astype(np.int64)
        owner, at = self.held.of(word)
        inside = [row[owner] * self.size + self.held.values[at]]
        if self.spaced.terms:
            inside += [number * self.size + whole_numbers(self.spaced.within(text)) for number, text in enumerate(texts)]
        owner, at = self.equal.of(word)
        counted, place = np.unique(row[owner] * self.size + self.equal.values[at], return_inverse=True)
        counts = np.bincount(place, weights=times[owner], minlength=len(counted)).astype(np.int64)
        return np.unique(np.concatenate(inside)), counted, counts, lengths


def parts_of(batch: pd.DataFrame, text: str, width: int) -> Iterator[pd.DataFrame]:
    """A batch in parts of bounded text and at most ``CELLS_AT_ONCE`` cells of rows by ``width``; a row at least."""
    rows = max(1, CELLS_AT_ONCE // max(width, 1))
    chars = batch[text].str.len().fillna(0).to_numpy().cumsum() if len(batch) else np.zeros(0)
    start = 0
    while start < len(batch):
        before = chars[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(chars, before + CHARS_AT_ONCE, side="right")))
        stop = min(stop, start + rows)
        yield batch.iloc[start:stop]
        start = stop


def term_frequencies(corpus: DataFrame, terms: list[str]) -> DataFrame:
    """``(term, matches)``: chunks whose lower-cased content contains a term, where any does.

    Every task counts over its own chunks, so only a number per term and task is shuffled.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, counts = Words(terms), np.zeros(len(terms), dtype=np.int64)
        for batch in batches:
            for part in parts_of(batch, "text", 1):
                contained, *_ = held.of(part["text"].tolist())
                counts += np.bincount(contained % max(len(terms), 1), minlength=len(terms))
        some = np.flatnonzero(counts)
        if len(some):
            yield pd.DataFrame({"term": [terms[i] for i in some], "matches": counts[some]})

    partial = corpus.select(F.lower("content").alias("text")).mapInPandas(count, "term string, matches long")
    return partial.groupBy("term").agg(F.sum("matches").alias("matches"))


def keyword_idf(corpus: DataFrame, keywords: DataFrame) -> DataFrame:
    """Chunks that contain each keyword and the keyword's weight; zero where none does."""
    asked = cut_lineage(keywords.select("keyword").distinct(), "keywords")
    found = None
    for rows in blocks_of(asked, "keyword", KEYWORD_BLOCK):
        part = term_frequencies(corpus, [row["keyword"] for row in rows])
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = corpus.sparkSession.createDataFrame([], "term string, matches long")
    total = corpus.select(F.count(F.lit(1)).alias("n")).scalar()
    weight = F.when(F.col("matches") > 0, inverse_frequency(total, F.col("matches"))).otherwise(0.0)
    return (
        asked.join(found.withColumnRenamed("term", "keyword"), "keyword", "left")
        .select("keyword", F.coalesce("matches", F.lit(0)).alias("matches"))
        .select("keyword", "matches", weight.alias("idf"))
    )


def bm25_term(idf: Column, tf: Column, length: Column) -> Column:
    k1, b = vocab.BM25_K1, vocab.BM25_B
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * length / F.lit(float(vocab.BM25_AVG_LENGTH)))
    return idf * (tf * F.lit(k1 + 1)) / (tf + norm)


def matches_section(title: Column | str, section: Column | str, preferred: Column) -> Column:
    """The title contains a preferred section, or the chunk's own section is one."""
    place = F.struct(F.lower(tx.col(title)).alias("title"), F.lower(tx.col(section)).alias("own"))
    return tx.let(
        place,
        lambda at: F.exists(
            F.transform(preferred, F.lower),
            lambda p: F.contains(at["title"], p) | F.coalesce(p == at["own"], F.lit(False)),
        ),
    )


def chunk_section(section: Column | str, title: Column | str) -> Column:
    """A chunk's section, or the one its title names."""
    from_title = tx.blank_to_null(F.upper(F.regexp_extract(tx.col(title), vocab.SECTION_PATTERN, 1)))
    return F.coalesce(
        section_code(tx.blank_to_null(section)), F.concat(F.lit("Section "), from_title), F.lit("")
    )


def phrase_matches(content: Column | str, phrases: Column) -> Column:
    return count_contained(F.lower(tx.col(content)), phrases)


def count_contained(text: Column, keys: Column) -> Column:
    return tx.let(text, lambda t: F.size(F.filter(keys, lambda k: F.contains(t, k)))).cast("long")


def heuristic_score(keyword_hits: Column, phrase_hits: Column, article_hit: Column, title_sections: Column) -> Column:
    """Points for phrases, keywords and the article; section points only when there are any others."""
    content = (
        phrase_hits * vocab.PHRASE_POINTS
        + keyword_hits * vocab.KEYWORD_POINTS
        + F.when(article_hit, F.lit(vocab.ARTICLE_POINTS)).otherwise(0)
    )
    return F.when(content == 0, F.lit(0)).otherwise(content + title_sections * vocab.SECTION_POINTS).cast("long")


class QuestionBlock:
    """A bounded block of questions as arrays: the keywords, phrases and sections that each asks for."""

    def __init__(self, rows: list[Row], phrase_rules):
        allowed = {phrase for _, phrase in phrase_rules}
        self.ids = [row["query_id"] for row in rows]
        self.keywords, self.asked = self._numbered([row["keywords"] or [] for row in rows])
        self.phrases, phrases = self._numbered([[p for p in row["phrases"] or [] if p in allowed] for row in rows])
        sections = [[s.lower() for s in row["sections"] or [] if s is not None] for row in rows]
        self.sections = sorted({s for own in sections for s in own})
        self.wanted = np.array([[own.count(s) for s in self.sections] for own in sections], dtype=np.int64)
        self.wanted = self.wanted.reshape(len(rows), len(self.sections))
        self.wants = self.wanted.any(axis=1)
        self.phrased = np.zeros((len(rows), len(self.phrases)), dtype=np.int64)
        np.add.at(self.phrased, (np.repeat(np.arange(len(rows)), phrases.lengths), phrases.values), 1)
        self.idf, self.matches = np.zeros(len(self.keywords)), np.zeros(len(self.keywords), dtype=np.int64)

    @staticmethod
    def _numbered(lists: list[list[str]]) -> tuple[list[str], Lists]:
        """Distinct terms, and the numbers of each question's terms in order."""
        numbers: dict[str, int] = {}
        own = [sorted(numbers.setdefault(term, len(numbers)) for term in terms if term) for terms in lists]
        return list(numbers), Lists(whole_numbers(map(len, own)), whole_numbers(chain.from_iterable(own)))

    def weigh(self, corpus: DataFrame, chunks: int) -> None:
        """Weights of the keywords over the whole corpus."""
        place = {keyword: i for i, keyword in enumerate(self.keywords)}
        for row in term_frequencies(corpus, self.keywords).collect():
            matches = row["matches"]
            self.matches[place[row["term"]]] = matches
            self.idf[place[row["term"]]] = np.log(1.0 + (chunks - matches + 0.5) / (matches + 0.5))

    def common(self) -> np.ndarray:
        """For every keyword its place among those that most pairs of question and chunk share, or -1."""
        askers = np.bincount(self.asked.values, minlength=len(self.keywords))
        work = askers * self.matches
        chosen = np.argsort(-work, kind="stable")[:COMMON_TERMS]
        chosen = chosen[work[chosen] > 0]
        place = np.full(len(self.keywords), -1)
        place[chosen] = np.arange(len(chosen))
        return place

    def slices(self, common: np.ndarray) -> Iterator[QuestionSlice]:
        for start in range(0, len(self.ids), QUESTION_SLICE):
            yield QuestionSlice(self, common, start, min(start + QUESTION_SLICE, len(self.ids)))

    def places(self, titles: Sequence[str | None], sections: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text and section whether the title names it, and whether it does or the own section is it."""
        known: dict[tuple, int] = {}
        which = [known.setdefault(place, len(known)) for place in zip(titles, sections)]
        named = [[title is not None and s in title for s in self.sections] for title, _ in known]
        same = [[s == own for s in self.sections] for _, own in known]
        named, same = (np.array(found, dtype=np.int64).reshape(len(known), -1) for found in (named, same))
        return named[which], (named | same)[which]


class QuestionSlice:
    """Some questions of a block, as a matrix of what many ask for and lists of who asks for the rest."""

    def __init__(self, block: QuestionBlock, common: np.ndarray, start: int, stop: int):
        self.start, self.stop, size = start, stop, stop - start
        owner, at = block.asked.of(np.arange(start, stop))
        term = block.asked.values[at]
        dense = common[term] >= 0
        weights = np.zeros((int(common.max(initial=-1)) + 1, size), dtype=np.float32)
        np.add.at(weights, (common[term[dense]], owner[dense]), 1)
        phrases = block.phrased[start:stop].T * vocab.PHRASE_POINTS
        self.weights = np.vstack([weights, phrases, block.wanted[start:stop].T * vocab.SECTION_POINTS]).astype(np.float32)
        owner, term = owner[~dense], term[~dense]
        self.askers = Lists(np.bincount(term, minlength=len(block.keywords)), owner[np.argsort(term, kind="stable")])
        self.wants = np.flatnonzero(block.wants[start:stop])
        self.wanted = block.wanted[start:stop][self.wants].T

    def ahead(self, scored: Scored, best: Best) -> tuple[np.ndarray, np.ndarray]:
        """Texts and questions, numbered in the block, whose score may be among the best; no other is."""
        width = self.stop - self.start
        score = scored.facts @ self.weights
        row, term, points = scored.rare
        owner, at = self.askers.of(term)
        place = row[owner] * width + self.askers.values[at]
        score += np.bincount(place, weights=points[owner], minlength=score.size).reshape(score.shape)
        apart, preferred = best.least(self.start, self.stop)
        taken = score >= apart
        if len(self.wants):
            own = (scored.places @ self.wanted) > 0
            least = np.where(own, preferred[self.wants], apart[self.wants])
            taken[:, self.wants] = score[:, self.wants] >= least
        row, question = np.divmod(np.flatnonzero(taken), width)
        return row, question + self.start


EVIDENCE = ["ord", "bm25", "keyword_hits", "phrase_hits", "article_hit", "heuristic", "preferred", "score"]


class Best:
    """The best ``limit`` rows of every question so far, as arrays; all rows without a limit.

    Rows come a chunk, or some pairs of question and chunk, at a time. Those behind the worst kept row of a question that
    has ``limit`` are not taken in.
    """

    def __init__(self, questions: int, limit: int | None):
        self.questions, self.limit = questions, limit
        self.floor_preferred = np.zeros(questions, dtype=bool)
        self.floor_score = np.zeros(questions)
        self.parts: list[list[np.ndarray]] = []
        self.size = 0

    def least(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """What a rough score must reach to be looked at, per question: in other sections, in preferred ones."""
        floor, whole = self.floor_score[start:stop], self.floor_preferred[start:stop]
        reach = np.maximum(floor * (1 - SCORE_SHARE) - SCORE_SLACK, LEAST_SCORE)
        return (
            np.where(whole, np.inf, reach).astype(np.float32),
            np.where(whole, reach, LEAST_SCORE).astype(np.float32),
        )

    def add(self, ord_: int, chunk: int, evidence: dict[str, np.ndarray]) -> None:
        """Take a chunk's evidence, an array over the questions each."""
        question = np.arange(self.questions)
        self.add_pairs(question, np.full(len(question), chunk), np.full(len(question), ord_), evidence)

    def add_pairs(
        self, question: np.ndarray, chunk: np.ndarray, ord_: np.ndarray, evidence: dict[str, np.ndarray]
    ) -> np.ndarray:
        """Take the evidence of pairs; the places of those it took."""
        preferred, score = evidence["preferred"], evidence["score"]
        floor_preferred, floor_score = self.floor_preferred[question], self.floor_score[question]
        level = (preferred == floor_preferred) & (score >= floor_score)
        taken = np.flatnonzero((score > 0) & ((preferred > floor_preferred) | level))
        if len(taken):
            rows = [question, chunk, *(evidence[name] for name in EVIDENCE[1:])]
            rows = [column[taken] if column.dtype != np.int64 else column[taken].astype(np.int32) for column in rows]
            self.parts.append([*rows[:2], ord_[taken], *rows[2:]])
            self.size += len(taken)
            if self.limit is not None and self.size > max(3 * self.limit * self.questions // 2, 1_000):
                self.cut()
        return taken

    def cut(self) -> None:
        """Keep what is best, in the order of questions and ranks."""
        if not self.parts:
            return
        columns, self.parts = [list(column) for column in zip(*self.parts)], []
        kept = slice(None)
        if self.limit is not None:
            question, ord_, preferred, score = (np.concatenate(columns[i]) for i in (0, 2, -2, -1))
            order = np.lexsort((ord_, -score, ~preferred, question))
            question = question[order]
            first = np.flatnonzero(np.r_[True, question[1:] != question[:-1]])
            rank = np.arange(len(question)) - np.repeat(first, np.diff(np.r_[first, len(question)]))
            kept, last = order[rank < self.limit], order[rank == self.limit - 1]
            full = question[rank == self.limit - 1]
            self.floor_preferred[full], self.floor_score[full] = preferred[last], score[last]
            del question, ord_, preferred, score, order, first, rank
        # One column after the other, so that no more than one is there twice.
        rows = [np.concatenate(columns.pop(0))[kept] for _ in range(len(columns))]
        self.parts, self.size = [rows], len(rows[0])

    def taken(self) -> list[np.ndarray]:
        self.cut()
        rows = self.parts[0] if self.parts else []
        self.parts, self.size = [], 0
        return rows


class Scored:
    """Some chunks' texts and what they hold of a block of questions."""

    def __init__(self, block: QuestionBlock, words: Words, phrases: Terms, common: np.ndarray, part: pd.DataFrame):
        k1, b = vocab.BM25_K1, vocab.BM25_B
        texts, self.rows, self.terms = part["lowered"].tolist(), len(part), max(len(block.keywords), 1)
        self.block = block
        self.cells, counted, counts, lengths = words.of(texts)
        at, keyword = np.divmod(counted, self.terms)
        norm = k1 * (1 - b + b * lengths / vocab.BM25_AVG_LENGTH)
        self.bm25 = np.zeros(len(self.cells))
        self.bm25[np.searchsorted(self.cells, counted)] = block.idf[keyword] * (counts * (k1 + 1)) / (counts + norm[at])
        held: dict[str | None, list[int]] = {}
        articles = part["lowered_article"].tolist()
        for article in articles:
            if article not in held:
                held[article] = words.inner.within(article) + words.spaced.within(article)
        self.named = whole_numbers(row * self.terms + term for row, text in enumerate(articles) for term in held[text])
        self.phrases = np.zeros((self.rows, len(block.phrases)), dtype=np.int64)
        for row, text in enumerate(texts):
            self.phrases[row, phrases.within(text)] = 1
        self.sections, self.places = block.places(part["lowered_title"].tolist(), part["lowered_section"].tolist())
        self._weigh(common)

    def _weigh(self, common: np.ndarray) -> None:
        """Points of a rough score: a matrix for common terms, phrases and sections, a list for the rest."""
        cells = np.append(self.cells, self.named)
        points = np.append(1 + self.bm25, np.full(len(self.named), float(vocab.ARTICLE_POINTS)))
        row, term = np.divmod(cells, self.terms)
        dense = common[term] >= 0 if len(common) else np.zeros(0, dtype=bool)
        facts = np.zeros((self.rows, int(common.max(initial=-1)) + 1))
        np.add.at(facts, (row[dense], common[term[dense]]), points[dense])
        self.facts = np.hstack([facts, self.phrases, self.sections]).astype(np.float32)
        self.rare = row[~dense], term[~dense], points[~dense]

    def evidence(self, row: np.ndarray, question: np.ndarray) -> dict[str, np.ndarray]:
        """All parts of the score of pairs of a text and a question; rows ascend."""
        block, height = self.block, max(1, CELLS_AT_ONCE // self.terms)
        table, named = np.zeros(height * self.terms, dtype=np.int32), np.zeros(height * self.terms, dtype=bool)
        weights = np.append(0.0, self.bm25)
        bm25, hits, article = np.zeros(len(row)), np.zeros(len(row), dtype=np.int64), np.zeros(len(row), dtype=bool)
        for first in range(0, self.rows, height):
            low, high = np.searchsorted(row, [first, first + height])
            if low == high:
                continue
            bounds = [first * self.terms, (first + height) * self.terms]
            start, stop = np.searchsorted(self.cells, bounds)
            cells = self.cells[start:stop] - bounds[0]
            table[cells] = np.arange(start, stop) + 1
            title = self.named[slice(*np.searchsorted(self.named, bounds))] - bounds[0]
            named[title] = True
            for at in range(low, high, ROWS_OUT):
                pairs = slice(at, min(at + ROWS_OUT, high))
                owner, place = block.asked.of(question[pairs])
                cell = (row[pairs] - first)[owner] * self.terms + block.asked.values[place]
                found, size = table[cell], pairs.stop - pairs.start
                bm25[pairs] = np.bincount(owner, weights=weights[found], minlength=size)
                hits[pairs] = np.bincount(owner[found > 0], minlength=size)
                if len(title):
                    article[pairs] = np.bincount(owner[named[cell]], minlength=size) > 0
            table[cells] = 0
            named[title] = False
        bm25 = np.round(bm25, 4)
        phrase_hits = (self.phrases[row] * block.phrased[question]).sum(axis=1)
        title_sections, preferred = np.zeros(len(row), dtype=np.int64), np.zeros(len(row), dtype=bool)
        own = np.flatnonzero(block.wants[question])
        title_sections[own] = (self.sections[row[own]] * block.wanted[question[own]]).sum(axis=1)
        preferred[own] = (self.places[row[own]] * block.wanted[question[own]]).any(axis=1)
        content = phrase_hits * vocab.PHRASE_POINTS + hits * vocab.KEYWORD_POINTS + article * vocab.ARTICLE_POINTS
        heuristic = np.where(content == 0, 0, content + title_sections * vocab.SECTION_POINTS)
        values = [bm25, hits, phrase_hits, article, heuristic, preferred, bm25 + heuristic]
        return dict(zip(EVIDENCE[1:], values))


def _scan(block: QuestionBlock, limit: int | None):
    """Score a partition's chunks for a block of questions; with a ``limit``, that many a question leave it.

    Rough scores of all pairs come first, in single precision: a matrix product for the terms that most pairs share, and
    sums over who asks for the others. Only pairs that may be among the best are scored in full.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, phrases = Words(block.keywords), Terms(block.phrases)
        common = block.common()
        slices = list(block.slices(common))
        best = Best(len(block.ids), limit)
        known: dict[int, tuple] = {}
        number = 0
        width = len(block.ids) if limit is None else min(QUESTION_SLICE, len(block.ids))
        for part in (part for batch in batches for part in parts_of(batch, "lowered", width)):
            scored = Scored(block, words, phrases, common, part)
            numbers, ords = number + np.arange(len(part)), part["ord"].to_numpy()
            facts = part[["chunk_id", "document_title", "section"]]
            for some in slices:
                ahead = some.ahead(scored, best)
                for start in range(0, len(ahead[0]), PAIRS_AT_ONCE):
                    row, question = (column[start : start + PAIRS_AT_ONCE] for column in ahead)
                    taken = best.add_pairs(question, numbers[row], ords[row], scored.evidence(row, question))
                    new = np.unique(row[taken])
                    known |= dict(zip(numbers[new].tolist(), facts.iloc[new].itertuples(index=False, name=None)))
            number += len(part)
            if len(known) > 4 * KNOWN_CHUNKS and limit is not None:
                best.cut()
                held = set(best.parts[0][1].tolist())
                known = {n: facts for n, facts in known.items() if n in held}
            if limit is None and best.size > ROWS_OUT:
                yield from named_rows(best.taken(), known)
                known = {}
        yield from named_rows(best.taken(), known)

    def named_rows(rows: list[np.ndarray], known: dict[int, tuple]) -> Iterator[pd.DataFrame]:
        """Rows under the names of their questions and chunks, some at a time."""
        for start in range(0, len(rows[0]) if rows else 0, ROWS_OUT):
            question, chunk, *evidence = (column[start : start + ROWS_OUT] for column in rows)
            evidence = [column if column.dtype != np.int32 else column.astype(np.int64) for column in evidence]
            facts = [known[n] for n in chunk.tolist()]
            named = {"query_id": [block.ids[i] for i in question.tolist()]}
            for i, name in enumerate(("chunk_id", "document_title", "section")):
                named[name] = [fact[i] for fact in facts]
            # Text columns of plain lists come in one Arrow chunk each, which Spark asks for.
            named = {name: pd.Series(values, dtype=object) for name, values in named.items()}
            yield pd.DataFrame(named | dict(zip(EVIDENCE, evidence)))

    return scan


def keyword_scores(
    corpus: DataFrame, parsed: DataFrame, phrase_rules=vocab.PHRASE_RULES, limit: int | None = None
) -> DataFrame:
    """Every ``(query_id, chunk_id)`` with a positive keyword score and the parts of the score.

    Chunks stay where they lie. A block of questions, of a bounded size, goes to all tasks, which find the block's
    keywords in each chunk at once and sum them per question. With a ``limit`` a task hands on that many chunks a
    question, so what is shuffled grows with questions and tasks, not with pairs of questions and chunks.
    """
    chunks = corpus.select(
        "chunk_id",
        F.col("ord").cast("long").alias("ord"),
        "document_title",
        chunk_section("section", "document_title").alias("section"),
        F.lower("content").alias("lowered"),
        F.lower("article").alias("lowered_article"),
        F.lower("document_title").alias("lowered_title"),
    ).withColumn("lowered_section", F.lower("section"))
    kinds = dict(corpus.dtypes) | {"query_id": dict(parsed.dtypes)["query_id"]}
    schema = (
        f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, document_title string, section string, ord long, "
        "bm25 double, keyword_hits long, phrase_hits long, article_hit boolean, heuristic long, preferred boolean, "
        "score double"
    )
    total, found = corpus.count(), None
    for rows in blocks_of(parsed.select("query_id", "keywords", "phrases", "sections"), "query_id", QUESTION_BLOCK):
        block = QuestionBlock(rows, phrase_rules)
        block.weigh(corpus, total)
        part = chunks.mapInPandas(_scan(block, limit), schema)
        found = part if found is None else found.unionByName(part)
    return corpus.sparkSession.createDataFrame([], schema) if found is None else found


def ranked(rows: DataFrame, key: str | list[str], order: list[Column], limit: int, rank: str = "rank") -> DataFrame:
    """First ``limit`` rows per key. Spark cuts each task's rows to ``limit`` per key before the shuffle."""
    window = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= limit)


def keyword_candidates(scores: DataFrame, limit: int = vocab.KEYWORD_CANDIDATES) -> DataFrame:
    order = [F.desc("preferred"), F.desc("score"), F.asc("ord")]
    return ranked(scores, "query_id", order, limit, "keyword_rank")


def whole_token(term: str) -> str:
    return f"(?<![a-z0-9]){term}(?![a-z0-9])"


def bm25_for_terms(corpus: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """Best chunks for a short list of terms known when the plan is built.

    The terms are literals, so scoring is one pass over the corpus: the counts stay in the row, the only
    shuffles are one partial count per term and the final ``limit`` rows of each task.
    """
    lowered = F.lower("content")
    scored = corpus.select(
        "chunk_id",
        F.regexp_count(lowered, F.lit("[a-z0-9]+")).alias("length"),
        *[F.regexp_count(lowered, F.lit(whole_token(k))).alias(f"tf{i}") for i, k in enumerate(terms)],
    )
    stats = corpus.select(lowered.alias("lowered")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.contains("lowered", F.lit(k))).alias(f"df{i}") for i, k in enumerate(terms)]
    )
    facts = stats.select(F.struct("*").alias("s")).scalar()
    score = sum(
        (
            bm25_term(
                F.when(facts[f"df{i}"] > 0, inverse_frequency(facts["n"], facts[f"df{i}"])).otherwise(0.0),
                F.col(f"tf{i}"),
                F.col("length"),
            )
            for i in range(len(terms))
        ),
        F.lit(0.0),
    )
    # Zero scores sort last, so dropping them after the limit loses nothing and scores are computed once.
    return (
        scored.select("chunk_id", F.round(score, 4).alias("bm25"))
        .orderBy(F.desc("bm25"), F.asc("chunk_id"))
        .limit(limit)
        .filter(F.col("bm25") > 0)
    )
