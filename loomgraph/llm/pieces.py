"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies, by an agenda of adjacent symbol pairs.

A text becomes a row of symbols, first its characters. Every adjacent pair whose concatenation is a piece stands on an
agenda ordered by score, ties from the left; the best is merged and its new neighbours join the agenda, until none is
left. Characters that are no piece fall back to their bytes. No piece of the usual models holds a word mark inside, so
the words of a text never merge with each other and each distinct word is worked out once per worker. Short words of one
length whose characters are pieces are worked out together: in each turn every one of them merges its best pair.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from .common import named

MARK = "▁"
#: Words that a worker remembers at a time; when they are full they become the old ones, which are dropped when the next
#: are full. This changes no result.
REMEMBERED = 120_000
#: Up to so many symbols the agenda is a plain row of scores, searched from the left; above, a heap.
SHORT = 40
#: Words of one length that are worked out together.
TOGETHER = 4096
#: Longer words are worked out anew each time.
LONGEST = 64
#: Of so many documents one is also encoded whole by the library, besides every word that is worked out and every text that
#: is not made of such words.
WHOLE_CHECK_EVERY = 64


class Pieces:
    """A vocabulary and its agenda. encode() gives ids exactly as the library does, without begin and end ids."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.library.get_piece_size()
        special = [i for i in range(n) if self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i)]
        self.bytes = {int(self.library.id_to_piece(i)[1:-1], 16): i for i in special if self.library.is_byte(i)}
        self.unknown = self.library.unk_id()
        names = [self.library.id_to_piece(i) for i in range(n)]
        skip = set(special)
        self.ids = {p: i for i, p in enumerate(names) if i not in skip and not self.library.is_unused(i)}
        self.scores = {p: self.library.get_score(i) for p, i in self.ids.items()}
        self.splits_words = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.splits_lines = self.splits_words and not any("\n" in p and len(p) > 1 for p in self.ids)
        self._pairs()
        self.known: list[dict[str, str]] = [{}, {}]  # words that begin with a mark or not -> ids, joined by commas
        self.old: list[dict[str, str]] = [{}, {}]

    def _pairs(self) -> None:
        """Of all pairs of pieces that make a piece: first * size + second, sorted, the places of their scores among all
        scores, and the pieces that they make; and of each character the piece that it is, or -1."""
        self.size = self.library.get_piece_size()
        place = {s: n for n, s in enumerate(sorted(set(self.scores.values())))}
        found = sorted((a * self.size + b, place[self.scores[p]], i) for p, i in self.ids.items() for k in range(1, len(p)) if (a := self.ids.get(p[:k])) is not None and (b := self.ids.get(p[k:])) is not None)
        self.keys, self.places, self.makes = (np.array([x[j] for x in found] + [end], dtype=np.int64) for j, end in enumerate((np.iinfo(np.int64).max, -1, -1)))
        self.character = np.full(sys.maxunicode + 1, -1, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.character[ord(p)] = i
        self.texts_of_ids = pa.array(map(str, range(self.size)), pa.string())

    def _at(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Where each pair is among the pairs of pieces; the last one, which makes nothing, where it is not."""
        key = first * self.size + second
        at = np.searchsorted(self.keys, key)
        at[self.keys.take(at) != key] = len(self.keys) - 1
        return at

    def agendas(self, symbols: np.ndarray) -> np.ndarray:
        """The agendas of many texts of one length at a time, whose characters are all pieces: (texts, length), the pieces
        that stand there at first -> those that are left, -1 behind them. In each turn every text merges its best pair."""
        rows, out = np.arange(len(symbols)), np.full(symbols.shape, -1, dtype=np.int64)
        pairs = self._at(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(symbols), -1)
        while len(rows) and pairs.shape[1]:
            scores = self.places.take(pairs)
            best = scores.argmax(axis=1)
            each = np.arange(len(rows))
            over = scores[each, best] < 0
            if over.any():
                out[rows[over], : symbols.shape[1]] = symbols[over]
                left = np.flatnonzero(~over)
                rows, symbols, pairs, best, each = rows[left], symbols[left], pairs[left], best[left], each[: len(left)]
            # All behind the pair moves up by one place.
            n = symbols.shape[1]
            merged = self.makes.take(pairs[each, best])
            symbols = symbols.ravel().take((each * n)[:, None] + np.arange(n - 1) + (np.arange(n - 1) > best[:, None]))
            symbols[each, best] = merged
            pairs = pairs.ravel().take((each * (n - 1))[:, None] + np.arange(n - 2) + (np.arange(n - 2) >= best[:, None]))
            for side in (0, 1):  # the new pairs with what stands behind it, and before it
                own = np.flatnonzero(best < n - 2) if side == 0 else np.flatnonzero(best > 0)
                at = best[own] - side
                pairs[own, at] = self._at(symbols[own, at], symbols[own, at + 1])
        out[rows, : symbols.shape[1]] = symbols
        return out

    def worked_out(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in which spaces are marks already, end to end, and how many each has."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        begins = np.cumsum(lengths) - lengths
        symbols = self.character.take(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)).astype(np.int64)
        alone = np.zeros(len(words), dtype=bool)
        alone[np.repeat(np.arange(len(words)), lengths)[symbols < 0]] = True
        alone |= (lengths > SHORT) | (lengths == 0)
        counts, parts, order = np.zeros(len(words), dtype=np.int64), [], []
        for n in np.unique(lengths[~alone]).tolist():
            same = np.flatnonzero((lengths == n) & ~alone)
            for start in range(0, len(same), TOGETHER):
                part = same[start : start + TOGETHER]
                found = self.agendas(symbols.take(begins[part][:, None] + np.arange(n)))
                counts[part] = (found >= 0).sum(axis=1)
                parts.append(found[found >= 0])
                order.append(part)
        for i in np.flatnonzero(alone).tolist():
            parts.append(np.array(self.agenda(words[i]), dtype=np.int64))
            order.append(np.array([i]))
            counts[i] = len(parts[-1])
        # From the order by length to that of the words.
        order = np.concatenate([*order, np.zeros(0, np.int64)])
        ends, to = np.cumsum(counts), counts[order]
        out = np.empty(counts.sum(), dtype=np.int64)
        out[np.repeat(ends[order] - np.cumsum(to), to) + np.arange(len(out))] = np.concatenate([*parts, np.zeros(0, np.int64)])
        return out, counts

    def agenda(self, text: str) -> list[int]:
        """Ids of a text in which spaces are marks already."""
        symbols = list(text)
        return self.numbers(self.merged_short(symbols) if len(symbols) <= SHORT else self.merged(symbols))

    def merged_short(self, symbols: list[str]) -> list[str]:
        score = self.scores.get
        never = -np.inf
        row = [score(a + b, never) for a, b in zip(symbols, symbols[1:])]  # noqa: B905
        while row and (best := max(row)) != never:
            i = row.index(best)
            symbols[i] += symbols.pop(i + 1)
            del row[i]
            if i < len(row):
                row[i] = score(symbols[i] + symbols[i + 1], never)
            if i:
                row[i - 1] = score(symbols[i - 1] + symbols[i], never)
        return symbols

    def merged(self, symbols: list[str]) -> list[str]:
        scores, n = self.scores, len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, str]] = []
        for i in range(n - 1):
            both = symbols[i] + symbols[i + 1]
            if (s := scores.get(both)) is not None:
                heap.append((-s, i, i + 1, both))
        heapq.heapify(heap)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if not symbols[i] or not symbols[j] or right[i] != j or len(symbols[i]) + len(symbols[j]) != len(both):
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = both, ""
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                more = both + symbols[k]
                if (s := scores.get(more)) is not None:
                    heapq.heappush(heap, (-s, i, k, more))
            h = left[i]
            if h >= 0:
                more = symbols[h] + both
                if (s := scores.get(more)) is not None:
                    heapq.heappush(heap, (-s, h, i, more))
        return [s for s in symbols if s]

    def numbers(self, symbols: list[str]) -> list[int]:
        out: list[int] = []
        for s in symbols:
            if (i := self.ids.get(s)) is not None:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in s.encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def learn(self, words: set[str], kind: int) -> None:
        """Have all words in known: they are there, are old ones, or are worked out now, each of which the library checks."""
        missing = [w for w in words if w not in self.known[kind]]
        if len(self.known[kind]) + len(missing) > REMEMBERED:
            self.old[kind], self.known[kind], missing = self.known[kind], {}, list(words)
        known, old, fresh = self.known[kind], self.old[kind], []
        for w in missing:
            if (x := old.get(w)) is None:
                fresh.append(w)
            else:
                known[w] = x
        ids, counts = self.worked_out([MARK + w for w in fresh] if kind == 0 else fresh)
        theirs = self.library.encode(fresh if kind == 0 else ["\n" + w for w in fresh], num_threads=1)
        skip = len(self.library.encode("\n")) if kind else 0
        their_counts = np.fromiter(map(len, theirs), dtype=np.int64, count=len(theirs)) - skip
        their_ids = np.fromiter((i for t in theirs for i in t[skip:]) if skip else chain.from_iterable(theirs), dtype=np.int64, count=their_counts.sum())
        if not np.array_equal(counts, their_counts) or not np.array_equal(ids, their_ids):
            raise ValueError(next(f"the agenda and the library differ on {w!r}" for w, n, e, t in zip(fresh, counts, np.cumsum(counts), theirs, strict=True) if ids[e - n : e].tolist() != t[skip:]))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), self.texts_of_ids.take(pa.array(ids)))
        known.update(zip(fresh, pc.binary_join(lists, ",").to_pylist(), strict=True))

    def plan(self, text: str) -> list[tuple[int, list[str]]] | None:
        """[(kind, words)] of a text that is made of single-spaced words, line by line; None where it has to be read as
        a whole: doubled, leading or trailing spaces, marks in the text, long words, or a model that merges across words."""
        if not self.splits_lines or MARK in text or "  " in text or text.startswith(" ") or " \n" in text or text.endswith(" "):
            return None
        out: list[tuple[int, list[str]]] = []
        for n, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if max(map(len, words)) > LONGEST:
                return None
            if n:
                out.append((1, ["\n" + words[0]]))
                words = words[1:]
            if words and (n or words != [""]):
                out.append((0, words))
            elif not n:
                out.append((1, [MARK]))  # the library's leading mark before a line end
        return out

    def whole(self, text: str) -> tuple[int, str]:
        """A text that is not made of remembered words: still cut at marks, where the model allows that."""
        if not text:
            return 0, ""
        marked = MARK + text.replace(" ", MARK)
        parts = re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", marked) if self.splits_words else [marked]
        if self.splits_lines:
            parts = [x for p in parts for x in re.findall("\n|[^\n]+", p)]
        ids = [i for p in parts for i in self.agenda(p)]
        if ids != self.library.encode(text, num_threads=1):
            raise ValueError(f"the agenda and the library differ on a text of {len(text)} characters")
        return len(ids), ",".join(map(str, ids))

    def encode_texts(self, texts: list[str]) -> list[tuple[int, str]]:
        """(number of ids, ids joined by commas) of each text."""
        plans = [self.plan(t) if t else None for t in texts]
        fresh: tuple[set[str], set[str]] = (set(), set())
        for p in plans:
            for kind, words in p or ():
                fresh[kind].update(words)
        for kind in (0, 1):
            self.learn(fresh[kind], kind)
        out = []
        for t, p in zip(texts, plans, strict=True):
            if p is None:
                out.append(self.whole(t))
                continue
            ids = ",".join([x for kind, words in p for x in map(self.known[kind].__getitem__, words)])
            out.append((ids.count(",") + 1, ids))
        return out


@lru_cache(maxsize=2)
def loaded(name: str) -> Pieces:
    """The vocabulary that the driver has added to the job's files, once per worker."""
    with open(SparkFiles.get(name), "rb") as f:
        return Pieces(f.read())


def add_model(spark, path: str) -> str:
    """Ship the model's file to the executors; its name there."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encoded(df: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """One row per row of df: its id, n_tokens, ids_sha256 and decoded_sha256, with_ids the ids and decoded text, and the
    columns of df named in keep (none of which may have one of these names).

    Null is the empty text, which has no ids. In every batch each word that is worked out is checked against the library,
    as is each text that is worked out as a whole, and one document of WHOLE_CHECK_EVERY; a difference stops the job. Texts of
    any length are encoded whole; rows are independent, so ties and repeated rows change nothing.
    """
    name = add_model(df.sparkSession, model_path)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(name)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):  # a slice's distinct words stay within what is remembered
                part = batch.slice(start, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                found = pieces.encode_texts(texts)
                decoded = []
                for i, (t, (_, ids)) in enumerate(zip(texts, found, strict=True)):
                    numbers = np.fromstring(ids, dtype=np.int32, sep=",").tolist() if ids else []
                    decoded.append(pieces.library.decode(numbers) if numbers else "")
                    if i % WHOLE_CHECK_EVERY == 0 and pieces.library.encode(t, num_threads=1) != numbers:
                        raise ValueError(f"the agenda and the library differ on a text of {len(t)} characters")
                digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
                columns = [part.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([digest(x[1]) for x in found]), pa.array([digest(d) for d in decoded])]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array([[int(v) for v in x[1].split(",")] if x[1] else [] for x in found], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                    names += ["ids", "decoded"]
                columns += [part.column(2 + i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *keep])

    schema = f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    schema += "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(named(id_col).alias("id"), named(text_col).cast("string").alias("text"), *map(named, keep)).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op9_pieces(spark, sf_dir: str) -> DataFrame:
    """All documents encoded with the 32,000-piece merge vocabulary, and decoded."""
    import public_tokenizers

    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
