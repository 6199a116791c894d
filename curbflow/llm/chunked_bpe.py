"""BPE encoding with content-defined chunks that documents share.

A rolling hash over the bytes of a text picks the places to cut, so equal passages
are cut alike wherever they stand. Chunks that occur more than once in the corpus are
encoded once, in a job of their own; a document without any is encoded where it is read.

For a tokenizer that works word by word (``Words``) a shared chunk gives the tokens of its inner
words, and the words that cuts may have split are put together from the chunks' ends and
encoded by themselves. For any other, joins are repaired: around every cut a window of the text, from a word before to a word
after the one that the cut may have split and with the blanks as they stand, is encoded as
one string. Where the tokens of its outer words equal those of the chunks, they take the
chunks' place; else the window takes in twice as many words, in the end the whole text. So
a tokenizer whose tokens cross blanks is encoded right as well, as long as what it does to
a word does not depend on text further away than such an agreement.

Which chunks are shared is found by counting chunk names. Documents with shared chunks send
their pieces through one join. A fixed-size bitmap tells a scan which names may be shared
(see ``common.sieve``); a false alarm costs a join row, never a result.

Cases: a null or empty text has no tokens. Repeated rows are each answered; rows that repeat
a (doc_id, text), told by a hash of both, share their pieces. Any text length is cut the
same way; a text without a word boundary is encoded whole. Only ``doc_id`` and ``text``
are read.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow.llm.common import in_sieve, map_rows, sieve, written

_WORD = re.compile("[^ \n\t\r]+")
_BLANK = re.compile("[ \n\t\r]")
_WINDOW = 5  # doublings: a cut depends on the 32 bytes before it
_GROUP_CHARS = 200_000  # text that goes to the library at once, and the most of one text as one string
_NEAR = 200  # characters on each side in which the words of a window are looked for first

_KNOWN_BYTES = 48 << 20  # what a worker remembers of words

_TOKENIZERS: dict = {}


def _ends(text: str) -> tuple[int, int] | None:
    """The end of what may be the rest of a word, and the start of what may be the begin of one."""
    first = _BLANK.search(text)
    return (first.start(), max(map(text.rfind, " \n\t\r")) + 1) if first else None


def _planes(ids: np.ndarray) -> bytes:
    """Byte by byte of all ids: the high ones are nearly all zero."""
    return np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(raw: bytes) -> bytes:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.tobytes()


class Words:
    """What words give by themselves, remembered within a bound of bytes.

    For tokenizers that split at blanks and look at nothing beyond: then the tokens of a
    text are those of its words, each of which goes through the library once.
    """

    def __init__(self, library):
        self.library = library
        self.known: dict[str, bytes] = {}
        self.held = 0

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if not new:
            return
        if self.held > _KNOWN_BYTES:
            self.known.clear()
            self.held = 0
            new = list(words)
        for at in range(0, len(new), 1000):  # many words as one text; a token is of the word it starts in
            part = new[at : at + 1000]
            found = self.library.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            starts = np.fromiter((o[0] for o in found.offsets), np.int64, len(ids))
            ends = np.cumsum([len(w) + 1 for w in part])
            edges = np.searchsorted(starts, np.r_[0, ends])
            raw, cut = ids.tobytes(), (4 * edges).tolist()
            self.known.update(zip(part, [raw[a:b] for a, b in zip(cut, cut[1:])]))
        self.held += 200 * len(new) + sum(map(len, new))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        split = [_WORD.findall(t) for t in texts]
        self.learn(set().union(*split))
        known = self.known
        return [np.frombuffer(b"".join([known[w] for w in words]), "<u4") for words in split]

    def inner(self, chunks: list[str]) -> list[tuple[str, bytes | None]]:
        """Of each chunk its outer words with a blank between them, and the ids of the words
        within; none of a chunk without a blank."""
        ends = [_ends(c) for c in chunks]
        ids = self.ids([c[e[0] : e[1]] if e else "" for c, e in zip(chunks, ends)])
        return [(c, None) if e is None else (f"{c[: e[0]]} {c[e[1] :]}", _planes(i)) for c, e, i in zip(chunks, ends, ids)]

    def joined(self, documents: list[list[tuple[str, bytes | None]]]) -> list[np.ndarray]:
        """Ids of documents given as chunks: of text, or as ``inner`` gives them."""
        every: list[list[str | bytes]] = []
        for parts in documents:
            out, open_word = [], ""
            for text, ids in parts:
                ends = _ends(text)
                if ends is None:
                    open_word += text
                    continue
                out.append(open_word + text[: ends[0]])
                out += _WORD.findall(text, *ends) if ids is None else [_unplanes(ids)]
                open_word = text[ends[1] :]
            every.append([x for x in (*out, open_word) if x])
        self.learn({x for items in every for x in items if isinstance(x, str)})
        known = self.known
        return [np.frombuffer(b"".join([known[x] if isinstance(x, str) else x for x in items]), "<u4") for items in every]

    def tokens(self, text: str) -> Tokens:
        """Every token with the place of its whole word."""
        words = _WORD.findall(text)
        self.learn(set(words))
        raw = [self.known[w] for w in words]
        each = np.array([len(r) // 4 for r in raw], np.int64)
        letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        within = np.zeros(len(letters) + 2, np.int8)
        within[1:-1] = (letters != 32) & (letters != 10) & (letters != 9) & (letters != 13)
        turns = np.diff(within)
        ids = np.frombuffer(b"".join(raw), "<u4")
        return Tokens(ids, np.repeat(np.flatnonzero(turns == 1), each), np.repeat(np.flatnonzero(turns == -1), each))


def tokenizer(path: str, word_by_word: bool = False):
    """The library's tokenizer, one per Python worker, on the task's own core; or a memory of
    its words (``Words``)."""
    if (path, word_by_word) not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        _TOKENIZERS[path, word_by_word] = Words(found) if word_by_word else found
    return _TOKENIZERS[path, word_by_word]


_GEAR = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(text: str, mask_bits: int = 10) -> list[int]:
    """Ends of the chunks, in code points; the last is the length. On average a cut
    every ``2**mask_bits`` bytes, depending only on the bytes just before it."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if raw.size == 0:
        return [0]
    h = _GEAR[raw]
    for i in range(_WINDOW):
        step = 1 << i
        h = h.copy()
        h[step:] += h[:-step].copy() * np.uint32(pow(3, step, 1 << 32))
    at = np.flatnonzero((h >> np.uint32(32 - mask_bits)) == 0) + 1
    if raw.size != len(text):  # bytes to code points; a cut inside a character moves to its end
        starts = np.cumsum((raw & 0xC0) != 0x80)
        at = starts[np.minimum(at, raw.size) - 1]
    at = np.unique(at)
    return [*at[at < len(text)].tolist(), len(text)]


def chunk_name(chunk: str) -> tuple[int, int]:
    """128 bits of a chunk's SHA-256, as two signed numbers."""
    digest = hashlib.sha256(chunk.encode("utf-8", "surrogatepass")).digest()
    return tuple(int.from_bytes(digest[i : i + 8], "little", signed=True) for i in (0, 8))


@dataclass
class Tokens:
    """Ids with the places they come from, in code points of a text."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def moved(self, by: int) -> Tokens:
        return Tokens(self.ids, self.starts + by, self.ends + by)

    def part(self, a: int, b: int | None) -> Tokens:
        return Tokens(self.ids[a:b], self.starts[a:b], self.ends[a:b])

    def packed(self) -> bytes:
        """Ids, distances of the starts and lengths, one after the other, deflated."""
        steps = np.diff(self.starts, prepend=0)
        parts = [self.ids.astype("<u4"), steps.astype("<i4"), (self.ends - self.starts).astype("<u4")]
        # byte by byte of all numbers: the high ones are nearly all zero
        return zlib.compress(b"".join([p.view(np.uint8).reshape(-1, 4).T.tobytes() for p in parts]), 1)

    @staticmethod
    def unpacked(raw: bytes) -> Tokens:
        planes = np.frombuffer(zlib.decompress(raw), np.uint8)
        n = len(planes) // 12
        ids, steps, length = (
            np.ascontiguousarray(planes[4 * n * k : 4 * n * (k + 1)].reshape(4, n).T).view(kind).reshape(n)
            for k, kind in enumerate(("<u4", "<i4", "<u4"))
        )
        starts = np.cumsum(steps).astype(np.int64)
        return Tokens(ids, starts, starts + length)

    @staticmethod
    def joined(parts: list[Tokens]) -> Tokens:
        return Tokens(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("ids", "starts", "ends")))


def encoded(texts: list[str], library) -> list[Tokens]:
    """Each text as one string, a bounded amount at a time."""
    if isinstance(library, Words):
        return [library.tokens(t) for t in texts]
    out: list[Tokens] = []
    group: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        group.append(text)
        size += len(text)
        if size >= _GROUP_CHARS or i == len(texts) - 1:
            for e in library.encode_batch(group, add_special_tokens=False):
                places = np.array(e.offsets, np.int64).reshape(-1, 2)
                out.append(Tokens(np.array(e.ids, np.uint32), places[:, 0], places[:, 1]))
            group, size = [], 0
    return out


def _outer(text: str, cut: int, words: int) -> tuple[int, int, int, int]:
    """A window around a cut: its start, the end of its first word, the start of its last
    word, its end. So many whole words stand on each side of the word that the cut may
    split; the window starts with the blanks before the first. -1 for an outer word where
    the text itself starts or ends the window."""
    near = _NEAR * words
    while True:
        low, high = max(0, cut - near), min(len(text), cut + near)
        before = [m.span() for m in _WORD.finditer(text, low, cut)]
        after = [m.span() for m in _WORD.finditer(text, cut, high)]
        if before and before[-1][1] == cut:
            before.pop()  # perhaps split
        if after and after[0][0] == cut:
            after.pop(0)
        # the outermost span of a slice may be a piece of a word
        enough_before = low == 0 or len(before) > words + 1
        enough_after = high == len(text) or len(after) > words + 1
        if enough_before and enough_after:
            break
        near *= 2
    start, first = (before[-words - 1][1], before[-words][1]) if len(before) > words else (0, -1)
    end, last = (after[words - 1][1], after[words - 1][0]) if len(after) > words else (len(text), -1)
    return start, first, last, end


def _same(old: Tokens, new: Tokens, chosen, within: bool) -> bool:
    mine, yours = chosen(old), chosen(new)
    return within and mine.any() and all(
        np.array_equal(getattr(old, c)[mine], getattr(new, c)[yours]) for c in ("ids", "starts", "ends")
    )


def repaired(text: str, cuts_at: list[int], tokens: Tokens, library) -> Tokens:
    """Tokens of the whole text from those of its chunks, which meet at ``cuts_at``."""
    out: list[Tokens] = []  # what lies before the last window
    last_window: Tokens | None = None
    begin = done = 0  # of the last window; up to its end the text is right
    rest = tokens
    for cut in cuts_at:
        if cut < done:
            continue  # inside a window already
        words = 1
        while True:
            start, first, last, end = _outer(text, cut, words)
            if last_window is not None and start < done:  # reaches into the last window
                rest, last_window = Tokens.joined([last_window, rest]), None
            if out and start < begin:  # and before it
                rest, out = Tokens.joined([*out, rest]), []
            i = int(np.searchsorted(rest.starts, start, side="left"))
            j = int(np.searchsorted(rest.ends, end, side="right"))
            old = rest.part(i, j)
            # no token reaches over the window's edges
            clean = (i == 0 or rest.ends[i - 1] <= start) and (j == len(rest.ids) or rest.starts[j] >= end) and i <= j
            [new] = encoded([text[start:end]], library)
            new = new.moved(start)
            whole = first < 0 and last < 0
            if whole:
                return new
            left = first < 0 or _same(old, new, lambda t: t.ends <= first, _breaks(old, first) and _breaks(new, first))
            right = last < 0 or _same(old, new, lambda t: t.starts >= last, _breaks(old, last) and _breaks(new, last))
            if clean and left and right:
                out += [rest.part(0, i)] if last_window is None else [last_window, rest.part(0, i)]
                last_window, rest = new, rest.part(j, None)
                begin, done = start, end
                break
            words *= 2
    return rest if last_window is None else Tokens.joined([*out, last_window, rest])


def _breaks(t: Tokens, at: int) -> bool:
    """Does no token reach over this place?"""
    return not ((t.starts < at) & (t.ends > at)).any()


def _chunks(text: str, mask_bits: int) -> list[str]:
    ends = cuts(text, mask_bits)
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def of_chunks(chunks: list[str], parts: list[Tokens], library) -> Tokens:
    """Tokens of the text that the chunks make up."""
    ends = np.cumsum([len(c) for c in chunks]).tolist()
    tokens = Tokens.joined([p.moved(at) for p, at in zip(parts, [0, *ends])])
    return repaired("".join(chunks), ends[:-1], tokens, library)


def encode_texts(texts: list[str], library, mask_bits: int = 10) -> list[np.ndarray]:
    """Ids of texts that share nothing. Very long ones go through the library in parts."""
    if isinstance(library, Words):
        return library.ids(texts)
    out: list = [None] * len(texts)
    short = [i for i, t in enumerate(texts) if len(t) <= _GROUP_CHARS]
    for i, found in zip(short, encoded([texts[i] for i in short], library)):
        out[i] = found.ids
    for i, text in enumerate(texts):
        if out[i] is None:
            parts, held = [], ""
            for chunk in _chunks(text, mask_bits):
                held += chunk
                if len(held) >= _GROUP_CHARS:
                    parts.append(held)
                    held = ""
            parts += [held] if held else []
            out[i] = of_chunks(parts, encoded(parts, library), library).ids
    return out


class _Decimals(dict):
    """Ids of a vocabulary as text, each made once."""

    def __missing__(self, i: int) -> str:
        self[i] = str(i)
        return self[i]


_DECIMALS = _Decimals()


class _Strings(dict):
    """What ids of a tokenizer stand for, each looked up once."""

    def __init__(self, library):
        self.library = library

    def __missing__(self, i: int) -> str:
        self[i] = self.library.id_to_token(i)
        return self[i]


_STRINGS: dict = {}


def decoded(ids: list[int], library) -> str:
    """As the library decodes. Without a decoder that is the tokens with a blank between them."""
    if id(library) not in _STRINGS:  # holds the library, so that its id stays its own
        _STRINGS[id(library)] = library, _Strings(library) if library.decoder is None else None
    strings = _STRINGS[id(library)][1]
    if strings is None:
        return library.decode(ids, skip_special_tokens=False)
    return " ".join(map(strings.__getitem__, ids))


def digests(ids: np.ndarray, library) -> tuple[int, str, str]:
    """Number of tokens, digests of the ids as text and of what they decode to."""
    own = ids.tolist()
    text = " ".join(map(_DECIMALS.__getitem__, own))
    back = decoded(own, getattr(library, "library", library))
    return len(own), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest()


_DONE = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def shared_chunks(texts: DataFrame, mask_bits: int) -> DataFrame:
    """``n1, n2``: names of the chunks that stand in more than one place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            names = [chunk_name(c) for t in b.column(0).to_pylist() if t for c in _chunks(t, mask_bits)]
            yield {"n1": [n[0] for n in names], "n2": [n[1] for n in names]}

    names = map_rows(texts.select("text"), run, "n1 bigint, n2 bigint", batch=500)
    return names.groupBy("n1", "n2").count().where("count > 1").select("n1", "n2")


def encode_documents(docs: DataFrame, path: str, mask_bits: int = 10, word_by_word: bool = False) -> DataFrame:
    """``doc_id``, ``n_tokens``, digests of the ids and of the decoded text."""
    ids = encoded_documents(docs, path, mask_bits, word_by_word, digest=True)
    return ids.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def encoded_documents(
    docs: DataFrame, path: str, mask_bits: int = 10, word_by_word: bool = False, digest: bool = False
) -> DataFrame:
    """``doc_id`` and ``ids``, the token ids of each text; with ``digest`` their number and
    digests in place of the ids. ``word_by_word`` states that the tokenizer's tokens
    never cross blanks nor depend on what stands beyond them (see ``Words``)."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shared = written(shared_chunks(texts, mask_bits), "shared-chunks")
    bitmap = sieve(shared, "n1")
    fields = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["ids"]
    result = _DONE if digest else "ids array<int>"

    def answer(ids: np.ndarray, library) -> tuple:
        return digests(ids, library) if digest else (ids.astype(np.int32),)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """Finished documents, and of the others every chunk, with its name where it may be shared."""
        library, bits = tokenizer(path, word_by_word), bitmap.value
        columns = ("doc_id", "row", *fields, "seq", "n1", "n2", "chunk")
        for b in batches:
            out: list[tuple] = []
            alone: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                chunks = _chunks(text, mask_bits)
                names = np.array([chunk_name(c) for c in chunks], dtype=np.int64)
                maybe = in_sieve(bits, np.ascontiguousarray(names[:, 0]))
                if not maybe.any():
                    alone.append((doc_id, text))
                    continue
                row = hashlib.sha256(f"{doc_id}\0{text}".encode("utf-8", "surrogatepass")).digest()[:16]
                for i, (c, name, m) in enumerate(zip(chunks, names.tolist(), maybe.tolist())):
                    out.append((doc_id, row, *[None] * len(fields), i, *(name if m else (None, None)), c))
            for (doc_id, _), ids in zip(alone, encode_texts([t for _, t in alone], library, mask_bits)):
                out.append((doc_id, None, *answer(ids, library), None, None, None, None))
            yield dict(zip(columns, map(list, zip(*out)))) if out else {c: [] for c in columns}

    pieces = written(
        map_rows(texts, scan, f"doc_id bigint, row binary, {result}, seq int, n1 bigint, n2 bigint, chunk string", batch=200),
        "chunks",
    )
    bitmap.destroy()
    done = pieces.where("row is null").select("doc_id", *fields)
    waiting = pieces.where("row is not null")
    # rows that repeat a (doc_id, text) share their pieces; count them and answer each
    copies = waiting.where("seq = 0").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("copies"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        library = tokenizer(path, word_by_word)
        for b in batches:
            texts = b.column(2).to_pylist()
            if word_by_word:
                texts, tokens = map(list, zip(*library.inner(texts))) if texts else ([], [])
            else:
                tokens = [t.packed() for t in encoded(texts, library)]
            yield {"n1": b.column(0), "n2": b.column(1), "text": texts, "tokens": tokens}

    # each shared chunk is encoded once: equal chunks meet after a partial aggregation
    named = waiting.where("n1 is not null")
    shared_tokens = map_rows(
        named.groupBy("n1", "n2").agg(F.first("chunk").alias("chunk")).select("n1", "n2", "chunk"),
        encode,
        "n1 bigint, n2 bigint, text string, tokens binary",
        batch=500,
    )
    # its places travel as names until they meet the tokens
    found = named.select("row", "seq", "n1", "n2").join(shared_tokens, ["n1", "n2"])
    found = found.select("row", "seq", F.col("text").alias("chunk"), "tokens")
    own = waiting.where("n1 is null").select("row", "seq", "chunk", F.lit(None).cast("binary").alias("tokens"))
    # a document's parts meet in one row, repeated rows as a set: no more than the document
    whole = found.unionAll(own).groupBy("row").agg(F.sort_array(F.collect_set(F.struct("seq", "chunk", "tokens"))).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        library = tokenizer(path, word_by_word)
        for b in batches:
            out = []
            if word_by_word:
                documents = [[(p["chunk"], p["tokens"]) for p in parts] for parts in b.column(1).to_pylist()]
                out = [answer(ids, library) for ids in library.joined(documents)]
            for parts in [] if word_by_word else b.column(1).to_pylist():
                fresh = iter(encoded([p["chunk"] for p in parts if p["tokens"] is None], library))
                tokens = [next(fresh) if p["tokens"] is None else Tokens.unpacked(p["tokens"]) for p in parts]
                out.append(answer(of_chunks([p["chunk"] for p in parts], tokens, library).ids, library))
            columns = map(list, zip(*out)) if out else ([] for _ in fields)
            yield {"row": b.column(0), **dict(zip(fields, columns))}

    joined = map_rows(whole, join, f"row binary, {result}", batch=200)
    answered = joined.join(copies, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return done.unionByName(answered.select(*done.columns))
