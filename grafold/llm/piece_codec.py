"""Exact SentencePiece BPE encoding by backtracking, and decoding.

The library merges the best-scored adjacent pair again and again. Its result has a local test: tokens
t1..tn are the encoding exactly if every adjacent pair, merged afresh from its characters, comes out as
that pair. So the encoder walks left to right over Aho-Corasick matches, longest first, keeps a token
if it is compatible with the one before (the answers are kept by pair), steps back when no match is,
and marks positions from which there is no way on in a bitfield so that none is tried twice.

No piece has a space after another character, so texts fall apart before spaces, around newlines
and between letters and others (as far as the model's pieces show that none spans such a place) into
words that are encoded alone; a bounded memo keeps the commonest.

Null text is encoded like empty text; any other text, however long, is encoded whole.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in each of the memo's two generations, and of those only up to this many characters; pairs kept.
MEMO_WORDS, MEMO_CHARS, PAIR_MEMO = 300_000, 40, 2_000_000
SPACE = "▁"


class PieceCodec:
    """Encoder and decoder of one model, given as the bytes of its file (BPE, identity normaliser)."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        if sp.encode(" ﬁ  x ", out_type=str)[:1] == [] or sp.decode(sp.encode("ﬁ  x ")) != "ﬁ  x ":
            raise ValueError("the model normalises text; only the identity normaliser is supported")
        self.text: list[str | None] = []  # of an ordinary piece
        self.rank: dict[str, tuple[float, int]] = {}
        self.byte: dict[int, int] = {}  # id -> byte
        self.byte_id: dict[int, int] = {}
        for i in range(sp.get_piece_size()):
            piece, plain = sp.id_to_piece(i), not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
            self.text.append(piece if plain else None)
            if sp.is_byte(i):
                self.byte[i], self.byte_id[int(piece[3:5], 16)] = int(piece[3:5], 16), i
            elif plain:
                self.rank[piece] = (-sp.get_score(i), i)
        if len(self.byte_id) not in (0, 256):
            raise ValueError("the model has some byte pieces, but not all")
        if any("\n" in p or " " in p or SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("the model has pieces that words cannot be cut at")
        # Letters and others part too, but for letters that stand beside others in some piece; those count as others.
        letter = re.compile(r"[^\W\d_]").match
        mixed = {x for p in self.rank for a, b in zip(p.lstrip(SPACE), p.lstrip(SPACE)[1:], strict=False) if bool(letter(a)) != bool(letter(b)) for x in (a, b) if letter(x)}
        odd = "".join(map(re.escape, sorted(mixed)))
        one, other = re.compile(rf"[^\W\d_{odd}]").match, rf"[\W\d_{odd}]"
        if any(bool(one(a)) != bool(one(b)) for p in self.rank for a, b in zip(p.lstrip(SPACE), p.lstrip(SPACE)[1:], strict=False)):
            self._cut = re.compile(r" *[^ \n]+| +|\n").findall
        else:
            self._cut = re.compile(rf" *(?:[^\W\d_{odd}]+|(?:(?![ \n]){other})+)| +|\n").findall
        self.trie = ahocorasick.Automaton()
        for piece in self.rank:
            self.trie.add_word(piece, piece)
        self.trie.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.memo: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}

    def merged(self, text: str) -> list[str]:
        """The library's merging, as it is defined: best score first, then leftmost. Slow; for pairs."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r[0] < best):
                    best, at = r[0], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: str, right: str) -> bool:
        """Whether two tokens can stand side by side; with left empty, whether a token can stand at all."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIR_MEMO:
                self.pairs.clear()
            known = self.merged(left + right) == ([left, right] if left else [right])
            self.pairs[left, right] = known
        return known

    def tokens(self, text: str) -> list[str]:
        """The pieces of one run of text, in which spaces are SPACE already."""
        n = len(text)
        starts: list[list[str]] = [[] for _ in range(n)]
        for end, piece in self.trie.iter(text):
            starts[end - len(piece) + 1].append(piece)  # by end, so by rising length
        for i, found in enumerate(starts):
            if not found or len(found[0]) > 1:
                found.insert(0, text[i])  # a character of no piece stands for its bytes
        failed = bytearray(n // 8 + 1)
        out: list[str] = []
        tried: list[int] = []  # index of the match taken at each token's start
        pos, nxt, last = 0, len(starts[0]) - 1 if n else -1, ""
        while pos < n:
            found = starts[pos]
            while nxt >= 0:
                piece = found[nxt]
                end = pos + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1 and self.compatible(last, piece):
                    break
                nxt -= 1
            if nxt >= 0:
                out.append(piece)
                tried.append(nxt)
                pos, last = end, piece
                nxt = len(starts[pos]) - 1 if pos < n else -1
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                if not out:
                    raise AssertionError("no encoding: the merge rules contradict each other")
                pos -= len(out.pop())
                last = out[-1] if out else ""
                nxt = tried.pop() - 1
        return out

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.tokens(text):
            if (r := self.rank.get(piece)) is not None:
                out.append(r[1])
            elif self.byte_id:
                out.extend(self.byte_id[b] for b in piece.encode())
            else:
                out.append(self.unk)
        return out

    def _word(self, word: str) -> tuple[bytes, str]:
        entry = self.older.get(word)
        if entry is None:
            ids = self.ids(word.replace(" ", SPACE))
            entry = array("I", ids).tobytes(), self._plain(ids)
        if len(word) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_WORDS:
                self.older, self.memo = self.memo, self.older
                self.memo.clear()
            self.memo[word] = entry
        return entry

    def words(self, text: str) -> list[tuple[bytes, str]]:
        """(ids as little-endian 32-bit integers, their decoding) of each word of the text, the first with
        its added space. The space sign itself counts as a space, as in the library."""
        word = self._word
        return [self.memo.get(w) or word(w) for w in self._cut(" " + text.replace(SPACE, " "))] if text else []

    def encode(self, text: str) -> list[int]:
        """The ids of a text with the begin and end ids."""
        return [self.bos, *array("I", b"".join(w[0] for w in self.words(text))), self.eos]

    def _plain(self, ids) -> str:
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            if i in self.byte:
                raw.append(self.byte[i])
                continue
            if raw:
                out.append(_utf8(raw))
                raw.clear()
            if self.text[i] is not None:
                out.append(self.text[i].replace(SPACE, " "))
            elif i == self.unk:
                out.append(" ⁇ ")
        return "".join(out) + (_utf8(raw) if raw else "")

    def decode(self, ids) -> str:
        """The library's decoding: control ids vanish, bytes form characters, the added first space goes."""
        text = self._plain(ids)
        first = next((i for i in ids if self.byte.get(i) is not None or self.text[i] is not None or i == self.unk), None)
        return text[1:] if first is not None and (self.text[first] or "").startswith(SPACE) else text


def _utf8(raw: bytearray) -> str:
    """Bytes as characters; each byte that is part of none becomes U+FFFD."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(bytes(raw[i : i + n]).decode())
            except UnicodeDecodeError:
                continue
            i += n
            break
        else:
            out.append("�")
            i += 1
    return "".join(out)


_codecs: dict[bytes, PieceCodec] = {}


def codec(model: bytes) -> PieceCodec:
    """The codec of a model, one in each Python process."""
    key = hashlib.sha256(model).digest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = PieceCodec(model)
    return _codecs[key]


def _digests(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        head, tail = array("I", [c.bos]).tobytes(), array("I", [c.eos]).tobytes()
        sha = hashlib.sha256
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                n, ids, back = [], [], []
                for text in part.column("text").to_pylist():
                    found = c.words(text or "")
                    raw = b"".join([head, *[w[0] for w in found], tail])
                    n.append(len(raw) // 4)
                    ids.append(sha(raw).hexdigest())
                    back.append(sha("".join([w[1] for w in found])[1:].encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encoded(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([c.encode(t or "") for t in part.column("text").to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def _decoded(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([c.decode(x or []) for x in part.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return run


def read_model(path: str) -> bytes:
    """The model's bytes, read on the driver; they go to the executors with the code (half a megabyte)."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, ids array<int>) with begin and end ids. Rows stay as they are, repeated ones too."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encoded(model), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """encoded(doc_id, ids) -> (doc_id, text). Null ids: empty text."""
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_decoded(model), "doc_id long, text string")


def encode_digests(docs: DataFrame, model: bytes) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_tokens, ids_sha256, decoded_sha256): encoded and decoded in one
    pass, of which only lengths and SHA-256 digests are kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_digests(model), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_model() -> bytes:
    import public_tokenizers

    return read_model(public_tokenizers.path("piece_bpe_32k.model"))


def op6_piece_codec(spark, sf_dir: str) -> DataFrame:
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model())
