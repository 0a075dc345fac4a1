"""BPE as a bounded-lookahead streaming transducer, and its inverse.

Encoding. Text is cut at white space into runs, each run is normalised and cut into pieces by the tokenizer's
pattern, and each piece's byte symbols are merged by rank. Pieces longer than a window aren't merged whole:
``lookahead(merges)`` gives the number of symbols right of a token that can still decide it, so the transducer
merges a window, emits the tokens that end that far from the window's right edge, and goes on from the last one.
That restart is exact, since no merge crosses a token's end: both sides of it merge as if they stood alone.
The state is one window, whatever the piece's length, and ids leave in batches as they become stable, so that neither the
symbols nor the ids of a text are ever held together. Only a run without white space is held as such, in its normal form.
Pieces that came up before are kept in a bounded cache.

Sufficient lookahead. Whether the merge (u, v) happens at the right end of what is known depends on whether v's
symbols are all still there. A symbol x that ends v can only be taken away by a merge (x, y) of lower rank, which in
turn depends on y's symbols. Hence la(u, v) = |v| + max la(x, y) over the merges (x, y) of lower rank with x a suffix
of v, and the bound is the greatest la, worked out in one pass over the merges in rank order.

Decoding. Both digests grow batch by batch: that of the ids as they are emitted, that of the text as the decoder turns these
ids back. A vocabulary like this one has no decoder, so the library's ``decode`` joins the tokens by spaces;
``Decoder`` emits those token by token. ``TextDecoder`` turns the tokens' byte symbols back into bytes and these
into text by an incremental UTF-8 state machine that holds back an unfinished character.

Nulls: a null text counts as empty (no token, both digests those of the empty string). A null doc_id is carried
along; repeated rows are repeated; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import batched, chain

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import clean_columns, small_batches, table

#: Unicode white space, as the tokenizer's pattern means it.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CACHE, WINDOW = 300_000, 4096
#: Text is fed in steps of so many characters.
FEED = 1 << 16


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it is printable Latin-1, else the next from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in shown else chr(256 + extra))
        extra += b not in shown
    return out


def lookahead(merges: Iterable[tuple[str, str]], width=len) -> int:
    """Symbols right of a token's end that suffice to tell that no later symbol changes it. ``width``: symbols of a token."""
    best: dict[str, int] = {}
    most = 1
    for u, v in merges:
        la = max((best[v[k:]] for k in range(len(v)) if v[k:] in best), default=0) + width(v)
        if la > best.get(u, 0):
            best[u] = la
        most = max(most, la)
    return most


class Merger:
    """Merges a piece's symbols by rank. Symbols and tokens are ids; ``pairs`` maps a pair to (rank, id)."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        self.vocab, self.suffix = vocab, suffix
        self.pairs = {(vocab[a] << 20) | vocab[b]: (k << 20) | vocab[a + b] for k, (a, b) in enumerate(merges) if a + b in vocab}
        self.tokens = {i: t for t, i in vocab.items()}
        # A symbol of the vocabulary is a byte, alone or with the suffix.
        bare = lambda t: t[: -len(suffix)] if suffix and t.endswith(suffix) else t
        self.ahead = lookahead(merges, lambda t: len(bare(t)))
        self.window = max(WINDOW, 4 * self.ahead)

    def merge(self, ids: list[int]) -> list[int]:
        pairs, n = self.pairs, len(ids)
        if n > 64:
            return self._merge_long(ids)
        none = 1 << 60
        ranks = [pairs.get((ids[i] << 20) | ids[i + 1], none) for i in range(n - 1)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i] = new = best & 0xFFFFF
            del ids[i + 1]
            del ranks[i]
            if i:
                ranks[i - 1] = pairs.get((ids[i - 1] << 20) | new, none)
            if i < len(ranks):
                ranks[i] = pairs.get((new << 20) | ids[i + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        import heapq

        pairs, n = self.pairs, len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(p, i) for i in range(n - 1) if (p := pairs.get((ids[i] << 20) | ids[i + 1])) is not None]
        heapq.heapify(heap)
        dead = bytearray(n)
        while heap:
            p, i = heapq.heappop(heap)
            j = nxt[i]
            if dead[i] or j >= n or pairs.get((ids[i] << 20) | ids[j]) != p:
                continue
            ids[i], dead[j], nxt[i] = p & 0xFFFFF, 1, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
                if (q := pairs.get((ids[i] << 20) | ids[nxt[i]])) is not None:
                    heapq.heappush(heap, (q, i))
            if prv[i] >= 0 and (q := pairs.get((ids[prv[i]] << 20) | ids[i])) is not None:
                heapq.heappush(heap, (q, prv[i]))
        return [ids[i] for i in range(n) if not dead[i]]

    def width(self, token: int) -> int:
        t = self.tokens[token]
        return len(t) - len(self.suffix) if self.suffix and t.endswith(self.suffix) else len(t)

    def stream(self, symbols: Iterable[int]) -> Iterator[int]:
        """Tokens of a piece, each as soon as it is stable. The state is one window of symbols."""
        held: list[int] = []
        for s in symbols:
            held.append(s)
            if len(held) >= self.window:
                at = 0
                for t in self.merge(held.copy()):
                    w = self.width(t)
                    if at + w > len(held) - self.ahead:
                        break
                    at += w
                    yield t
                held = held[at:]
        yield from self.merge(held)


class Transducer:
    """The tokenizer of one JSON file: ``pieces(text)`` gives batches of (ids, the same in decimal, joined by spaces)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.merger = Merger(model["vocab"], [tuple(m) for m in model["merges"]], self.suffix)
        self.symbols = byte_symbols()
        self.plain = [model["vocab"][s] for s in self.symbols]
        self.last = [model["vocab"][s + self.suffix] for s in self.symbols]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(split.replace(r"\s", WHITE))
        self.white = regex.compile(f"[{WHITE}]+")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.names = self.merger.tokens | {i: t for t, i in self.special.items()}
        self.cache: dict[str, tuple[tuple[int, ...], str]] = {}

    def normalise(self, run: str) -> str:
        # Lower case goes character by character, so a capital sigma never becomes a final one.
        run = run if run.isascii() else unicodedata.normalize("NFC", run).replace("Σ", "σ")
        return self.white.sub(" ", run).lower()

    def piece(self, p: str) -> tuple[tuple[int, ...], str]:
        b = p.encode()
        symbols = [*(self.plain[x] for x in b[:-1]), self.last[b[-1]]]
        ids = tuple(self.merger.stream(symbols) if len(b) > self.merger.window else self.merger.merge(symbols))
        out = (ids, " ".join(map(str, ids)))
        if len(p) <= 64:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[p] = out
        return out

    def long_piece(self, p: str) -> Iterator[list[tuple[tuple[int, ...], str]]]:
        """A piece of any length, a batch of stable ids at a time."""

        def symbols() -> Iterator[int]:
            for at in range(0, len(p), FEED):
                b = p[at : at + FEED].encode()
                ends = at + FEED >= len(p)
                yield from (self.plain[x] for x in (b[:-1] if ends else b))
                if ends:
                    yield self.last[b[-1]]

        for ids in batched(self.merger.stream(symbols()), FEED // 8):
            yield [(ids, " ".join(map(str, ids)))]

    def runs(self, text: str) -> Iterator[str]:
        """The text in steps that end before white space."""
        at = 0
        while at < len(text):
            end = at + FEED
            if end < len(text):
                cut = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end))
                if cut < 0:
                    m = self.white.search(text, end)
                    cut = m.start() if m else len(text)
                end = cut
            yield text[at:end]
            at = end

    def pieces(self, text: str) -> Iterator[list[tuple[tuple[int, ...], str]]]:
        get, make = self.cache.get, self.piece
        parts = self.cut(text) if "<|" in text else [text]
        for part in parts:
            if part in self.special:
                yield [((self.special[part],), str(self.special[part]))]
                continue
            for run in self.runs(part):
                run = self.normalise(run)
                if len(run) <= 2 * FEED:
                    yield [get(p) or make(p) for p in self.find.findall(run)]
                    continue
                for m in self.find.finditer(run):
                    if m.end() - m.start() > FEED:
                        yield from self.long_piece(m.group())
                    else:
                        yield [get(m.group()) or make(m.group())]

    def encode(self, text: str) -> list[int]:
        return [i for group in self.pieces(text) for ids, _ in group for i in ids]


class Decoder:
    """Incremental ``decode`` of a vocabulary without a decoder: the tokens, joined by spaces."""

    def __init__(self, tokens: dict[int, str]) -> None:
        self.tokens, self.begun = tokens, False

    def feed(self, ids: Iterable[int]) -> str:
        out = " ".join([self.tokens[i] for i in ids if i in self.tokens])
        out = " " + out if self.begun and out else out
        self.begun = self.begun or bool(out)
        return out


class TextDecoder:
    """Byte symbols of tokens back to text: an incremental UTF-8 state machine; a word's end gives one space."""

    def __init__(self, tokens: dict[int, str], suffix: str) -> None:
        self.tokens, self.suffix = tokens, suffix
        self.byte = {s: b for b, s in enumerate(byte_symbols())}
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], final: bool = False) -> str:
        out = []
        for i in ids:
            t = self.tokens[i]
            ends = bool(self.suffix) and t.endswith(self.suffix)
            t = t[: -len(self.suffix)] if ends else t
            out.append(self.utf8.decode(bytes(self.byte[c] for c in t)) + " " * ends)
        return "".join(out) + self.utf8.decode(b"", final)


_transducers: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _transducers:
        _transducers[path] = Transducer(path)
    return _transducers[path]


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row: texts go through both machines step by step."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    small_batches(docs.sparkSession)

    def digest(text: str, t: Transducer) -> tuple[int, str, str]:
        n, ids, decoded, joint = 0, hashlib.sha256(), hashlib.sha256(), b""
        decoder = Decoder(t.names)
        for group in t.pieces(text):
            if not group:
                continue
            emitted, decimal = zip(*group)
            emitted = list(chain.from_iterable(emitted))
            n += len(emitted)
            ids.update(joint + " ".join(decimal).encode())
            decoded.update(decoder.feed(emitted).encode())
            joint = b" "
        return n, ids.hexdigest(), decoded.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in batches:
            rows = [digest(x or "", t) for x in b.column(1).to_pylist()]
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return clean_columns(docs, "doc_id", "text").mapInArrow(run, kinds)


def op8_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
