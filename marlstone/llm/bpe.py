"""BPE encoding and decoding of whole texts with forced boundaries.

A pair of adjacent bytes that is inside no token of the vocabulary can never end up
in one token, so a text may be cut there without changing its encoding. White space
is such a boundary too, because the tokenizer drops it. The resulting fragments are
few and recur: each is encoded once for a worker, on its own, and a text's ids are
its fragments' ids end to end.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.shingles import text_slices
from marlstone.llm.storage import small_batches

#: Chunks and fragments remembered by a worker, in each of two generations.
REMEMBERED = 120_000
SLICE = 1_000_000
_BREAK = re.compile(rb"[ \t-\r]")
#: The normaliser and split of the vocabularies that this encoder is for, and the pieces of a lower-case ASCII word under them.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Place of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class Remembered:
    """A table of two generations: when the young one is full it becomes the old one, whose unused entries go."""

    def __init__(self, most: int) -> None:
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.most = most

    def missing(self, keys: Iterable[bytes]) -> list[bytes]:
        keys = set(keys)
        wanted = keys.difference(self.young)
        if len(self.young) + len(wanted) > self.most and self.young:
            self.old, self.young = self.young, {}
            wanted = keys
        found = wanted.intersection(self.old)
        for k in found:
            self.young[k] = self.old[k]
        return list(wanted.difference(found))


class ForcedBoundaryBPE:
    """Encoder and decoder of one vocabulary file of byte-level BPE with word ends.

    Only files with the normaliser and split above are read; another one raises a ValueError.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.letters = byte_letters()
        self.visible = dict(enumerate(self.letters)) | {10: "\n"}
        split = next((p for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"), {"pattern": None})
        if spec["normalizer"] != NORMALIZER or split["pattern"] != {"Regex": PATTERN} or spec["model"]["type"] != "BPE" or spec["decoder"] is not None:
            raise ValueError(f"{path} has another normaliser, split, model or decoder than this encoder is for")
        self.words = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), split["behavior"].lower(), split["invert"])
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        by_letter = {c: b for b, c in enumerate(self.letters)}
        size = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.tokens = [b""] * size
        self.inside = np.zeros((256, 256), bool)
        for token, i in spec["model"]["vocab"].items():
            self.tokens[i] = token.encode()
            body = token.removesuffix(self.suffix) or token
            codes = [by_letter[c] for c in body]
            self.inside[codes[:-1], codes[1:]] = True
        for t in spec["added_tokens"]:
            self.tokens[t["id"]] = t["content"].encode()
        bare = spec | {"added_tokens": [], "normalizer": None, "post_processor": None, "pre_tokenizer": {"type": "Split", "pattern": {"String": "\n"}, "behavior": "Removed", "invert": False}}
        self.last = Tokenizer.from_str(json.dumps(bare))  # a word's last fragment
        self.inner = Tokenizer.from_str(json.dumps(bare | {"model": spec["model"] | {"end_of_word_suffix": None}}))
        self.chunks = Remembered(REMEMBERED)
        self.fragments = {True: Remembered(REMEMBERED), False: Remembered(REMEMBERED)}

    def _pieces(self, chunks: list[bytes]) -> list[list[bytes]]:
        """The normalised words of each chunk, as the tokenizer parts them."""
        out: list[list[bytes]] = [[]] * len(chunks)
        others = []
        for i, c in enumerate(chunks):
            if c.isalpha():
                out[i] = [c.lower()]
            elif c.isascii():
                out[i] = _PIECES.findall(c.lower())
            else:
                others.append(i)
        if others:
            joined = b"\x00".join(chunks[i] for i in others).decode("utf-8", "replace")
            normal = self.whole.normalizer.normalize_str(joined).split("\x00")
            if len(normal) != len(others):  # a chunk holds the separator
                normal = [self.whole.normalizer.normalize_str(chunks[i].decode("utf-8", "replace")) for i in others]
            begins = np.cumsum([0, *(len(n) + 1 for n in normal)])
            found: list[list[bytes]] = [[] for _ in others]
            pieces = self.words.pre_tokenize_str("\n".join(normal))
            owners = np.searchsorted(begins, [at[0] for _, at in pieces], side="right") - 1 if pieces else []
            for (piece, _), k in zip(pieces, owners, strict=True):
                found[k].append(piece.encode())
            for i, f in zip(others, found, strict=True):
                out[i] = f
        return out

    def cut(self, words: list[bytes]) -> dict[bytes, list[bytes]]:
        """The words that have forced boundaries, cut there; the others are one fragment each."""
        joined = np.frombuffer(b"\n".join(words), np.uint8)
        ends = np.cumsum([len(w) + 1 for w in words])
        cuts = ~self.inside[joined[:-1], joined[1:]]
        cuts &= (joined[:-1] != 10) & (joined[1:] != 10)
        at = np.flatnonzero(cuts) + 1
        owner = np.searchsorted(ends, at, side="right")
        out = {}
        for k, places in itertools.groupby(zip(owner.tolist(), at.tolist(), strict=True), key=lambda x: x[0]):
            word = words[k]
            begin = int(ends[k]) - len(word) - 1
            edges = [0, *(x - begin for _, x in places), len(word)]
            out[word] = [word[a:b] for a, b in itertools.pairwise(edges)]
        return out

    def _encode_fragments(self, fragments: Iterable[bytes], final: bool) -> None:
        known = self.fragments[final]
        new = known.missing(fragments)
        if not new:
            return
        text = "\n".join([f.decode("latin-1") for f in new]).translate(self.visible)
        found = (self.last if final else self.inner).encode(text, add_special_tokens=False)
        ids = np.array(found.ids, dtype="<u4").tobytes()
        ends = 4 * np.cumsum(np.bincount(np.array(found.word_ids, dtype=np.int64), minlength=len(new)))
        begin = 0
        for f, end in zip(new, ends.tolist(), strict=True):
            known.young[f] = ids[begin:end]
            begin = end

    def _learn(self, chunks: list[bytes]) -> None:
        plain = chunks
        together = b"\n".join(chunks)
        if any(s in together for s in self.special):
            plain = []
            for c in chunks:
                if any(s in c for s in self.special):
                    ids = self.whole.encode(c.decode("utf-8", "replace"), add_special_tokens=False).ids
                    self.chunks.young[c] = np.array(ids, dtype="<u4").tobytes()
                else:
                    plain.append(c)
        pieces = self._pieces(plain)
        words = list(set(itertools.chain.from_iterable(pieces)))
        parts = self.cut(words) if words else {}
        self._encode_fragments(itertools.chain((w for w in words if w not in parts), (p[-1] for p in parts.values())), True)
        self._encode_fragments((f for p in parts.values() for f in p[:-1]), False)
        last, inner = self.fragments[True].young, self.fragments[False].young
        whole = {w: b"".join([*(inner[f] for f in p[:-1]), last[p[-1]]]) for w, p in parts.items()}
        young = self.chunks.young
        for c, p in zip(plain, pieces, strict=True):
            young[c] = b"".join([whole[w] if w in whole else last[w] for w in p])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text, as little-endian unsigned 32-bit integers end to end."""
        if len(texts) == 1 and len(texts[0]) > 2 * SLICE:  # a very long text goes by parts, cut at white space
            return [b"".join(self.encode([part])[0] for part in parts_of(texts[0], SLICE))]
        chunked = [t.split() for t in texts]
        new = self.chunks.missing(itertools.chain.from_iterable(chunked))
        for k in range(0, len(new), 20_000):
            self._learn(new[k : k + 20_000])
        known = self.chunks.young
        return [b"".join([known[c] for c in chunks]) for chunks in chunked]

    def decode(self, ids: bytes) -> bytes:
        """The tokens' strings with a space between, in UTF-8, as the tokenizer decodes without a decoder of its own."""
        return b" ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def parts_of(text: bytes, size: int) -> Iterator[bytes]:
    """A text in parts of about ``size`` bytes, cut before white space; a longer run without any stays whole."""
    begin = 0
    while begin < len(text):
        found = _BREAK.search(text, min(begin + size, len(text)))
        end = found.start() if found else len(text)
        yield text[begin:end]
        begin = end


@cache
def encoder(path: str) -> ForcedBoundaryBPE:
    """One encoder for each worker process and vocabulary file."""
    return ForcedBoundaryBPE(path)


def _rows(path: str, digest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            column = batch.column(1).cast(pa.binary())
            for start, stop in text_slices(batch.column(1).cast(pa.string()), SLICE):
                ids = bpe.encode([t or b"" for t in column.slice(start, stop - start).to_pylist()])
                own = batch.column(0).slice(start, stop - start)
                count = pa.array([len(i) // 4 for i in ids], pa.int64())
                if digest:
                    shas = [pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string()) for xs in (ids, (bpe.decode(i) for i in ids))]
                    yield pa.RecordBatch.from_arrays([own, count, *shas], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    ends = pa.array(np.cumsum([0, *(len(i) // 4 for i in ids)]).astype(np.int32))
                    flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
                    yield pa.RecordBatch.from_arrays([own, count, pa.ListArray.from_arrays(ends, flat)], ["doc_id", "n_tokens", "ids"])

    return run


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Token ids of every whole text: ``doc_id, n_tokens, ids``, or with ``digest`` SHA-256 of the ids and of the decoded text.

    Null, empty and blank texts have no tokens. Special tokens' strings in a text become
    their ids. Rows are taken as they come: repeated rows repeat, null ids stay null,
    other columns are ignored, an empty table has an empty result.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(source.dtypes)["doc_id"]
    small_batches(docs.sparkSession)
    schema = f"doc_id {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>")
    return source.mapInArrow(_rows(path or vocabulary_path(), digest), schema)


def op8_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the vocabulary of 49 thousand tokens."""
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
