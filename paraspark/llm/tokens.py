"""Token ids of whole texts inside a task, through the ``tokenizers`` library.

``Ids(path)`` gives a text's ids as packed little-endian integers. Where the
vocabulary file says that white space only separates (it is dropped, and the
text is lower-cased and split by a fixed pattern), the ids of a text are the
ids of its space-separated chunks put one after the other, so each distinct
chunk is tokenised once per worker and looked up afterwards; the cache is
cleared when it reaches its bound, which changes the speed and nothing else.
Any other vocabulary goes through ``encode`` text by text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Default vocabulary file (a parameter of every operator that tokenises).
VOCAB_FILE = "word_bpe_49k.json"
#: Entries of the per-worker chunk cache (about 150 bytes each).
CACHE_ENTRIES = 400_000
#: Bytes of the texts whose chunks ``arrays`` tells apart at a time (a longer text alone).
SLICE_BYTES = 8 << 20

# FIXED VALUES: the split pattern, normalisers and end-of-word mark of the
# public vocabulary file; the shortcut applies only where a file states them.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALISERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]

# The same pattern restricted to printable ASCII and Latin-1 letters (all of
# them their own NFC form), where Python's re agrees with it character by
# character; a chunk with any other character is given to the library whole.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(VOCAB_FILE)


def _byte_letters() -> dict[int, str]:
    """The published byte-to-letter rule of byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(keep)]
    return {**{b: chr(b) for b in keep}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class Ids:
    """``Ids(path).packed(text)``: the ids as bytes of ``dtype``."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        pre = (conf.get("pre_tokenizer") or {}).get("pretokenizers") or []
        self.by_chunk = ((conf.get("normalizer") or {}).get("normalizers") == _NORMALISERS
                         and [p.get("type") for p in pre] == ["Split", "ByteLevel"]
                         and pre[0]["pattern"] == {"Regex": _SPLIT} and pre[0]["behavior"] == "Removed" and pre[0]["invert"]
                         and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"]
                         and conf["model"]["type"] == "BPE"
                         and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"]
                                     for t in conf.get("added_tokens", [])))
        if self.by_chunk:
            self._chunks = _Chunks(self.tok, self.dtype, cache_entries,
                                   [t["content"] for t in conf.get("added_tokens", [])])

    def packed(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_chunk:
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        return b"".join(map(self._chunks.__getitem__, text.replace("\n", " ").split(" ")))

    def array(self, text: str | None, end_id: int | None = None) -> np.ndarray:
        tail = b"" if end_id is None else np.array([end_id], self.dtype).tobytes()
        return np.frombuffer(self.packed(text) + tail, self.dtype)

    def arrays(self, texts: pa.Array, end_id: int) -> Iterator[np.ndarray]:
        """``array`` of every text. The chunks are told apart by Arrow, so that
        each distinct one is looked up once for many texts."""
        if not self.by_chunk:
            for t in texts:
                yield self.array(t.as_py(), end_id)
            return
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            done = int(size[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + SLICE_BYTES, "right")))
            ids, ends = self._flat(texts.slice(at, to - at), end_id)
            for a, b in zip([0, *ends], ends):
                yield ids[a:b]
            at = to

    def _flat(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, list[int]]:
        """The ids of the texts one after the other, and where each text's end."""
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        chunks = split.flatten().dictionary_encode()
        ids = list(map(self._chunks.__getitem__, chunks.dictionary.to_numpy(zero_copy_only=False).tolist()))
        # the end id as one more chunk, after the last of each text
        ids.append(np.array([end_id], self.dtype).tobytes())
        last = split.offsets.to_numpy()[1:].astype(np.int64) - split.offsets[0].as_py()
        chunk = np.insert(chunks.indices.to_numpy(), last, len(ids) - 1)
        flat = pa.array(ids, pa.large_binary()).take(pa.array(chunk))
        _, end, data = flat.buffers()
        end = np.frombuffer(end, np.int64)[last + np.arange(len(last)) + 1] // self.dtype.itemsize
        return np.frombuffer(data, self.dtype, int(end[-1])), end.tolist()


class _Chunks(dict):
    """chunk -> packed ids, filled on a miss, bounded."""

    def __init__(self, tok, dtype, limit: int, added: list[str]):
        super().__init__()
        self.tok, self.dtype, self.limit = tok, dtype, limit
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.letters = _byte_letters()
        self.pieces = _Pieces(self)

    def pack(self, ids) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        if _PLAIN.fullmatch(chunk) and not (self.added and self.added.search(chunk)):
            # letters alone are one piece
            ids = self.pieces[chunk.lower()] if chunk.isalpha() else b"".join(map(self.pieces.__getitem__, _PIECE.findall(chunk.lower())))
        else:
            ids = self.pack(self.tok.encode(chunk, add_special_tokens=False).ids)
        self[chunk] = ids
        return ids


class _Pieces(dict):
    """Pre-split piece -> packed ids."""

    def __init__(self, owner: _Chunks):
        super().__init__()
        self.owner, self.model = owner, owner.tok.model

    def __missing__(self, piece: str) -> bytes:
        o = self.owner
        if len(self) >= o.limit // 2:
            self.clear()
        mapped = piece if piece.isascii() else "".join(map(o.letters.__getitem__, piece.encode()))
        ids = self[piece] = o.pack([t.id for t in self.model.tokenize(mapped)])
        return ids


_shared: dict[tuple[str, int], Ids] = {}


def shared(path: str, cache_entries: int = CACHE_ENTRIES) -> Ids:
    """One ``Ids`` per worker process and vocabulary (kept between tasks)."""
    key = (path, cache_entries)
    if key not in _shared:
        _shared[key] = Ids(path, cache_entries)
    return _shared[key]
