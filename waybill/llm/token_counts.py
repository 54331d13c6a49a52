"""Token counts of texts under a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton of the vocabulary lists every piece that ends at each place of a word;
a Viterbi pass carries, for each place, the best score of a segmentation ending there and how many
pieces it has. Scores add up in double precision in the order of the text, a later start must be
strictly better to replace an earlier one, and a character that is no piece of its own may be an
unknown at ten below the least score: the rules of the tokenizers whose counts these are. Unknowns
that follow each other are one; with byte fallback each counts its UTF-8 bytes.

Words are what the usual pre-tokenizer makes: each space becomes the mark that starts a word.
Words repeat, so each task keeps the counts of the words it met, up to a number of them; beyond
that it forgets and counts again. Word counts add up to the count of the text.

Defined results: a null or empty text has no tokens; repeated rows are counted each; a word as
long as a whole text costs time in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.words import bounded_batches

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words a task remembers, and the longest it does: a bound on memory, not on the texts.
REMEMBERED, REMEMBERED_CHARS = 200_000, 64
PRODUCTION_MODEL = "piece_bpe_32k.model"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with scores; `bytes_known`: the bytes that have a piece for byte fallback."""

    scores: dict[str, float]
    bytes_known: frozenset[int] = field(default_factory=frozenset)

    @property
    def unknown_score(self) -> float:
        return min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY


def from_sentencepiece(path: str) -> Vocabulary:
    """Pieces and scores of a model file; control, unknown and byte pieces don't match text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores, known = {}, set()
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            known.add(int(piece[1:-1], 16))
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            scores[piece] = model.get_score(i)
    return Vocabulary(scores, frozenset(known))


def words_of(text: str) -> list[str]:
    """The pre-tokenizer's words: each starts with the mark, which stands for a space."""
    if not text:
        return []
    marked = text.replace(" ", MARK)
    if not marked.startswith(MARK):
        marked = MARK + marked
    return [MARK + part for part in marked[1:].split(MARK)]


class Counter:
    """Counts the pieces of the best segmentation of a word."""

    def __init__(self, vocabulary: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        if vocabulary.scores:
            self.automaton.make_automaton()
        self.matches = bool(vocabulary.scores)
        self.unknown = vocabulary.unknown_score
        self.known = vocabulary.bytes_known
        self.characters = frozenset(p for p in vocabulary.scores if len(p) == 1)
        self.seen: dict[str, int] = {}

    def _unknown_run(self, run: str) -> int:
        """Tokens of unknown characters that follow each other."""
        data = run.encode("utf-8", "surrogatepass")
        return len(data) if all(b in self.known for b in data) else 1

    def word(self, word: str) -> int:
        if not self.characters.issuperset(word):
            return self._with_unknowns(word)
        # Every character is a piece, so every place is reached, and in order.
        best, pieces, reached = [0.0] * (len(word) + 1), [0] * (len(word) + 1), 0
        # At each place the automaton names the longest piece first: an equal one changes nothing.
        for last, (length, score) in self.automaton.iter(word):
            end = last + 1
            total = best[end - length] + score
            if end > reached or total > best[end]:
                best[end], pieces[end], reached = total, pieces[end - length] + 1, end
        return pieces[-1]

    def _with_unknowns(self, word: str) -> int:
        size = len(word)
        best: list[float] = [0.0] + [0.0] * size
        start: list[int] = [-1] * (size + 1)
        single = [False] * size
        ends: list[list[tuple[int, float]]] = [[] for _ in range(size + 1)]
        if self.matches:
            for last, (length, score) in self.automaton.iter(word):
                ends[last + 1].append((length, score))
                if length == 1:
                    single[last] = True
        for end in range(1, size + 1):
            # Longest first: of equal scores the earliest start stays.
            found = sorted(ends[end], reverse=True)
            if not single[end - 1]:
                found.append((1, self.unknown))
            for length, score in found:
                total = best[end - length] + score
                if start[end] < 0 or total > best[end]:
                    best[end], start[end] = total, end - length
        # Back along the best path; a one-character step without a piece of its own is unknown.
        count, at, unknown_end = 0, size, -1
        while at > 0:
            begin = start[at]
            unknown = begin == at - 1 and not single[begin]
            if unknown and unknown_end < 0:
                unknown_end = at
            if not unknown:
                if unknown_end >= 0:
                    count += self._unknown_run(word[at:unknown_end])
                    unknown_end = -1
                count += 1
            at = begin
        return count + (self._unknown_run(word[:unknown_end]) if unknown_end >= 0 else 0)

    def text(self, text: str | None) -> int:
        total, seen = 0, self.seen
        for word in words_of(text or ""):
            count = seen.get(word)
            if count is None:
                count = self.word(word)
                if len(word) <= REMEMBERED_CHARS:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[word] = count
            total += count
        return total


def counted(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """All rows and columns, with the token count of `text`; a column named `out` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            counts = [counter.text(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(counts, pa.int64())], names=["row", "count"])

    # The caller's columns travel in one struct, so their names can't clash.
    kept = [c for c in docs.columns if c != out]
    packed = bounded_batches(docs).select(F.col(text).cast("string").alias("text"), F.struct(*[F.col(c) for c in kept]).alias("row"))
    schema = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(run, f"row {schema}, count long").select("row.*", F.col("count").alias(out))


def counts(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and token count; the texts go no further."""
    return counted(docs.select(F.col(key), F.col(text)), vocabulary, text).select(key, "n_tokens")


def op7(spark, sf_dir: str, model_file: str | None = None) -> DataFrame:
    if model_file is None:
        import public_tokenizers

        model_file = str(public_tokenizers.path(PRODUCTION_MODEL))
    return counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), from_sentencepiece(model_file))
