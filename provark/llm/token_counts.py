"""Token counts: a count-only Viterbi over a unigram vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from provark.llm.common import text_batches, texts_of

SPACE = "▁"


class UnigramCounter:
    """Best segmentation under piece scores: its score and its number of pieces, never the pieces.

    Aho-Corasick gives, for each end, the vocabulary pieces that end there, longest first. Ties are the
    tokenizer's: starts go upwards and only a strictly better score replaces, so the earliest start stays.
    A character without a piece of its own may be unknown, at the least score minus 10, and then counts as
    its UTF-8 bytes. Scores add up in the order of the path from the segment's start.

    A text is cut before every space that follows something else, and at characters that no piece holds
    together with others, since every path goes through these places."""

    def __init__(self, pieces: list[tuple[str, float]], max_cached: int = 500_000):
        import ahocorasick

        self.pieces = dict(reversed(pieces))
        self.unknown = min(self.pieces.values(), default=0.0) - 10.0
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        if self.pieces:
            self.automaton.make_automaton()
        self.cut_spaces = not any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        self.cut_lines = not any("\n" in p for p in self.pieces)
        self.max_cached = max_cached
        self.joint = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.parts: dict[str, tuple[float, int]] = {}
        self.counts: dict[str, int] = {}
        self.scores: dict[str, float] = {}

    def _segment(self, text: str) -> tuple[float, int]:
        n = len(text)
        best = [0.0] * (n + 1)
        count = [0] * (n + 1)
        at, single, top, pieces = 0, False, None, 0
        unknown = self.unknown
        for end, (length, score) in self.automaton.iter(text) if self.pieces else ():
            while at < end:  # no more matches end at `at`
                if not single and (top is None or best[at] + unknown > top):
                    top, pieces = best[at] + unknown, count[at] + len(text[at].encode("utf-8", "surrogatepass"))
                at += 1
                best[at], count[at] = top, pieces
                single, top = False, None
            start = end + 1 - length
            value = best[start] + score
            if length == 1:
                single = True
            if top is None or value > top:
                top, pieces = value, count[start] + 1
        while at < n:
            if not single and (top is None or best[at] + unknown > top):
                top, pieces = best[at] + unknown, count[at] + len(text[at].encode("utf-8", "surrogatepass"))
            at += 1
            best[at], count[at] = top, pieces
            single, top = False, None
        return best[n], count[n]

    def segment(self, text: str) -> tuple[float, int]:
        """A segment's stretches, cut between characters that no piece holds side by side, in turn."""
        score, count, start = 0.0, 0, 0
        joint, parts = self.joint, self.parts
        for i in range(1, len(text) + 1):
            if i == len(text) or text[i - 1 : i + 1] not in joint:
                part = text[start:i]
                found = parts.get(part)
                if found is None:
                    if len(parts) >= self.max_cached:
                        parts.clear()
                    found = parts[part] = self._segment(part)
                score, count, start = score + found[0], count + found[1], i
        return score, count

    def _learn(self, segments) -> None:
        for s in segments:
            self.scores[s], self.counts[s] = self.segment(s)

    def segments(self, text: str) -> list[str]:
        if not self.cut_spaces:
            return [SPACE + text.replace(" ", SPACE)]
        out: list[str] = []
        lines = text.split("\n") if self.cut_lines else [text]
        for i, line in enumerate(lines):
            words = line.split(" ")
            if i:
                out.append("\n")
                if words[0]:
                    out.append(words[0])
            else:
                out.append(SPACE + words[0]) if words[0] else None
            run = "" if words[0] or i else SPACE
            for w in words[1:]:
                run += SPACE
                if w:
                    out.append(run + w)
                    run = ""
            if run:
                out.append(run)
        return out

    def count(self, text: str) -> tuple[int, float]:
        """Pieces and score of a whole text, with the space that the tokenizer puts before it; 0 for none."""
        if not text:
            return 0, 0.0
        parts = self.segments(text)
        new = set(parts).difference(self.counts)
        if new:
            if len(self.counts) + len(new) > self.max_cached:
                self.counts.clear()
                self.scores.clear()
                new = set(parts)
            self._learn(new)
        return sum(map(self.counts.__getitem__, parts)), float(sum(map(self.scores.__getitem__, parts)))


_COUNTERS: dict[str, UnigramCounter] = {}


def counter(vocabulary: str) -> UnigramCounter:
    """One counter a worker process; `vocabulary` names a SentencePiece file of public_tokenizers."""
    if vocabulary not in _COUNTERS:
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        _COUNTERS[vocabulary] = UnigramCounter([(sp.id_to_piece(i), float(sp.get_score(i))) for i in ids])
    return _COUNTERS[vocabulary]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """One row a document: doc_id, n_chars, n_tokens, score. A narrow map; nothing is shuffled.

    The vocabulary's pieces and scores are taken as a unigram model. Null or empty text has 0 tokens and
    score 0. Rows with the same id stay apart, null ids come back null, other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch in text_batches(batches):
            texts = texts_of(batch.column(1))
            counted = [own.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([c for c, _ in counted], pa.int64()), pa.array([s for _, s in counted], pa.float64())],
                names=["doc_id", "n_chars", "n_tokens", "score"],
            )

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_chars long, n_tokens long, score double")
