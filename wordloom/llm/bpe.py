"""BPE encoding and decoding with forced boundaries."""

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, types as T
from tokenizers import Tokenizer
from tokenizers.models import BPE

from wordloom.llm.words import slices

KNOWN_FRAGMENTS = 1 << 18  # of each half of a task's memo; when one is full, the older half is dropped
_KNOWN_LENGTH = 64  # longer fragments are not remembered


_LATIN = re.compile("[\x21-\u024f]+")  # letters and digits on which all regular expressions agree
_OTHER_SPACE = re.compile(r"[^\S\x20\x09-\x0D]")


def _byte_letters() -> dict[int, int]:
    """The public byte-level alphabet: visible bytes stand for themselves, the others follow at 256."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: 256 + i for i, b in enumerate(sorted(set(range(256)).difference(visible)))}


_LETTERS = _byte_letters()


def _pattern(cut: dict | None):
    """The pattern of a tokenizer that keeps its matches, drops the rest and then works on bytes."""
    steps = (cut or {}).get("pretokenizers", [])
    if len(steps) != 2 or steps[0].get("type") != "Split" or steps[1].get("type") != "ByteLevel":
        return None
    kept = steps[0]["behavior"] == "Removed" and steps[0]["invert"] and "Regex" in steps[0]["pattern"]
    return regex.compile(steps[0]["pattern"]["Regex"]) if kept and not (
        steps[1]["use_regex"] or steps[1]["add_prefix_space"]) else None


class _Pieces(dict):
    """Ids of the pieces a pattern cuts out, remembered while a task runs."""

    def __init__(self, coder: "FragmentCoder"):
        self.coder = coder

    def __missing__(self, piece: str) -> bytes:
        found = self.coder._piece(piece.encode().decode("latin-1").translate(_LETTERS))
        if len(piece) <= _KNOWN_LENGTH:
            if len(self) >= KNOWN_FRAGMENTS:
                self.clear()
            self[piece] = found
        return found


class FragmentCoder:
    """Encodes like the tokenizers library, one independent fragment at a time.

    Two characters that stand side by side in no token of the vocabulary can never be merged into
    one, so a cut between them changes nothing: the fragments on both sides are encoded on their own
    and their ids are concatenated. White space that the tokenizer drops cuts the raw text in the same
    way, which allows the ids of frequent fragments to be remembered.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        model = config["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix"):
            raise ValueError("a plain BPE vocabulary is needed")
        special = config.get("added_tokens") or []
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in special):
            raise ValueError("added tokens must be matched in the raw text")
        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in special}
        names = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        suffix = model.get("end_of_word_suffix")
        plain = {k: v for k, v in model.items() if k in ("unk_token", "fuse_unk", "byte_fallback") and v}
        self.inner = BPE(model["vocab"], merges, **plain)
        self.last = self.tokenizer.model if suffix else self.inner
        words = [w.removesuffix(suffix) if suffix else w for w in model["vocab"]]
        self.pairs = {w[i:i + 2] for w in words for i in range(len(w) - 1)}
        self.drops_space = not self.tokenizer.encode(" \t\n\x0b\f\r", add_special_tokens=False).ids
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.pieces = _Pieces(self)
        self.pattern = _pattern(config.get("pre_tokenizer"))

    def fragments(self, piece: str) -> list[str]:
        """The piece, cut between every two characters that no token holds side by side."""
        pairs = list(map("".join, zip(piece, piece[1:])))
        if self.pairs.issuperset(pairs):
            return [piece]
        cuts = [0, *(i for i, pair in enumerate(pairs, 1) if pair not in self.pairs), len(piece)]
        return [piece[i:j] for i, j in zip(cuts, cuts[1:])]

    def _piece(self, piece: str) -> bytes:
        """The ids of one byte-level piece that the tokenizer's own pattern cuts out."""
        *inner, last = self.fragments(piece)
        ids = [t.id for t in self.last.tokenize(last)]
        if inner:
            ids = [t.id for f in inner for t in self.inner.tokenize(f)] + ids
        return array("i", ids).tobytes()

    def _cut(self, normal: str) -> list[str]:
        """The byte-level pieces of a normalized text, by the library."""
        cut = self.tokenizer.pre_tokenizer
        return [piece for piece, _ in cut.pre_tokenize_str(normal)] if cut else [normal]

    def _normal(self, text: str) -> str:
        return self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text

    def _encode(self, raw: str) -> bytes:
        out = []
        for part in self.special_pattern.split(raw) if self.special_pattern else [raw]:
            if part in self.special:
                out.append(array("i", [self.special[part]]).tobytes())
            elif part:
                out += [self._piece(piece) for piece in self._cut(self._normal(part)) if piece]
        return b"".join(out)

    def _learn(self, fragments: list[bytes]) -> None:
        """Remember the ids of fragments without ASCII white space; many are normalized in one call."""
        texts = b"\n".join(fragments).decode()
        odd = _OTHER_SPACE.search(texts) or (self.special_pattern and self.special_pattern.search(texts))
        parts = [] if odd else self._normal(texts).split(" ")
        if len(parts) == len(fragments) and self.pattern:
            known, cut = self.pieces, self.pattern.findall
            for raw, part in zip(fragments, parts):
                if part.isascii() or _LATIN.fullmatch(part):
                    self.known[raw] = b"".join([known[piece] for piece in cut(part)])
                else:
                    self.known[raw] = b"".join(map(self._piece, self._cut(part)))
        elif len(fragments) > 1:  # white space beyond ASCII or special tokens: halve until they stand alone
            half = len(fragments) // 2
            self._learn(fragments[:half])
            self._learn(fragments[half:])
        elif fragments:
            self.known[fragments[0]] = self._encode(texts)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as 32-bit integers."""
        if not self.drops_space:
            return [self._encode(t) if t else b"" for t in texts]
        parts = [t.encode().split() if t else [] for t in texts]
        every = set().union(*parts)
        if len(self.known) >= KNOWN_FRAGMENTS:
            self.known, self.older = {}, self.known
        again = every.difference(self.known).intersection(self.older)
        self.known.update(zip(again, map(self.older.__getitem__, again)))
        self._learn(list(every.difference(self.known)))
        out = [b"".join(map(self.known.__getitem__, p)) for p in parts]
        for part in every:
            if len(part) > _KNOWN_LENGTH:
                del self.known[part]
        return out


class TokenReader:
    """Texts of token ids, as the tokenizers library decodes them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        tokens = {v: k for k, v in config["model"]["vocab"].items()}
        tokens |= {t["id"]: t["content"] for t in config.get("added_tokens") or []}
        self.names = np.full(max(tokens) + 2, None, object)  # the last one stands for unknown ids
        for i, token in tokens.items():
            self.names[i] = token
        # without a decoder the library puts a space between tokens and leaves unknown ids out
        self.tokenizer = None if config.get("decoder") is None else Tokenizer.from_file(path)

    def decode(self, ids: np.ndarray) -> str:
        if self.tokenizer:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        found = self.names[np.where((ids >= 0) & (ids < len(self.names)), ids, -1)].tolist()
        try:
            return " ".join(found)
        except TypeError:
            return " ".join([t for t in found if t is not None])

    def decode_all(self, lists: pa.ListArray) -> list[str]:
        ids = pc.fill_null(lists.values, -1).to_numpy()
        offsets = lists.offsets.to_numpy()
        return [self.decode(ids[a:b]) if there else ""
                for a, b, there in zip(offsets, offsets[1:], lists.is_valid().to_pylist())]


def _list_of_ids(parts: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def encode(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids): the token ids of each whole text.

    A null or empty text, or one of white space only, has an empty list. Rows and null ids stay as they
    are, repeated rows too; other columns are not read; an empty table gives an empty result. Strings
    of special tokens inside a text become their ids, as in the library.
    """
    kind = docs.schema[id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = FragmentCoder(path)
        for batch in slices(batches, 256):
            parts = coder.encode_all(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), _list_of_ids(parts)], [id, "ids"])

    schema = T.StructType([T.StructField(id, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(id, text).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """All columns and the text that the library's decode() makes of the ids; null ids give an empty text."""
    schema = T.StructType([*encoded.schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = TokenReader(path)
        for batch in slices(batches, 256):
            texts = reader.decode_all(batch.column(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.names)

    return encoded.mapInArrow(run, schema)
