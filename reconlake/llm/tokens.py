"""Exact token ids of whole texts, worked out once per distinct piece of text instead of once per occurrence.

For a tokenizer that drops white space (its pre-tokens never cross a blank), a text's ids are the ids of its
blank-separated chunks in order. Chunks are found and deduplicated by Arrow's compute kernels, each distinct chunk
is encoded once, and per-document ids or counts are gathered from the chunk table by index. Chunks of plain Latin
text take a short way (lower-casing and splitting by Arrow, merges by the library's own model); every other chunk
goes through the library's whole tokenizer. Other tokenizers encode whole texts with their library.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from contextlib import contextmanager
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from reconlake.llm.shared import CACHES, give_back, ragged_take, release, text_slices

#: The split pattern of the white-space-dropping tokenizer family, as in its file.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Chunks with any other character than these, or with the start of a special token, go the library's own way.
PLAIN = r"[\x21-\x7E\x{A1}-\x{12F}\x{131}-\x{24F}]"
SPECIAL = "<|"

SLICE_BYTES = 4 << 20
#: New chunks worked out together, and jobs of a thousand pre-tokens given to the library together: what this takes for a while.
LEARNT_AT_ONCE, JOBS = 1 << 18, 64
#: Of the table of chunks in a worker: their number and their bytes, beyond which it starts anew.
MAX_CHUNKS, MAX_CHUNK_BYTES = 300_000, 16 << 20


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_characters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(other)) for b in range(256)}


class WordEncoder:
    """Ids of Arrow string arrays under a tokenizer that drops white space; keeps a bounded table of chunks."""

    def __init__(self, path: str, max_chunks: int = MAX_CHUNKS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.library.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.library.get_vocab()
        self.dtype = np.dtype("<u2") if max(vocabulary.values()) < 1 << 16 else np.dtype("<u4")
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.alphabet = _byte_characters() | {10: "\n"}
        self.max_chunks, self.room = max_chunks, 1
        self.forget()

    def forget(self) -> None:
        """Drop the table of chunks."""
        self.slot: dict[str, int] = {"": 0}
        self.held = 0
        self.start = np.zeros(1, np.int64)
        self.length = np.zeros(1, np.int64)
        self.ids = np.zeros(0, self.dtype)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and piece counts of lower-case pre-tokens."""
        spelled = "\n".join(words).encode().decode("latin1").translate(self.alphabet).split("\n")
        jobs = [" ".join(spelled[i : i + 1000]) for i in range(0, len(spelled), 1000)]
        # the library's results are far larger than their ids: few jobs at a time
        parts = [np.array([i for e in self.merges.encode_batch_fast(jobs[i : i + JOBS], add_special_tokens=False) for i in e.ids], self.dtype) for i in range(0, len(jobs), JOBS)]
        flat = np.concatenate(parts) if parts else np.zeros(0, self.dtype)
        ends = np.flatnonzero(self.closes[flat]) + 1
        if len(ends) != len(words):
            return self._each([x.ids for x in self.merges.encode_batch_fast(spelled, add_special_tokens=False)])
        return flat, np.diff(ends, prepend=0)

    def _each(self, lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([i for ids in lists for i in ids], self.dtype), np.array([len(x) for x in lists], np.int64)

    def _plain(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parted = pc.replace_substring_regex(pc.utf8_lower(chunks), f"({WORD_PATTERN})", r"\1 ")
        parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(parted))
        coded = parts.flatten().dictionary_encode()
        flat, counts = self._words(coded.dictionary.to_pylist())
        starts, index = np.cumsum(counts) - counts, coded.indices.to_numpy()
        bounds = np.diff(parts.offsets.to_numpy())
        lengths = counts[index]
        per_chunk = np.add.reduceat(lengths, np.cumsum(bounds) - bounds) if len(bounds) else lengths
        return ragged_take(flat, starts[index], lengths), per_chunk

    def _letters(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for chunks of letters alone: each is one pre-token, so none is looked for."""
        coded = pc.utf8_lower(chunks).dictionary_encode()
        flat, counts = self._words(coded.dictionary.to_pylist())
        index = coded.indices.to_numpy()
        return ragged_take(flat, (np.cumsum(counts) - counts)[index], counts[index]), counts[index]

    def _odd(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = chunks.to_pylist()
        return self._each([e.ids for i in range(0, len(texts), 1000) for e in self.library.encode_batch_fast(texts[i : i + 1000], add_special_tokens=False)])

    def _learn(self, new: list[str]) -> None:
        chunks = pa.array(new, pa.string())
        plain = pc.ascii_is_printable(chunks).to_numpy(zero_copy_only=False)
        if not plain.all():  # the pattern is dear, and few need it
            plain[~plain] = pc.match_substring_regex(chunks.filter(pa.array(~plain)), f"^{PLAIN}+$").to_numpy(zero_copy_only=False)
        plain &= ~pc.match_substring(chunks, SPECIAL).to_numpy(zero_copy_only=False)
        letters = plain & pc.utf8_is_alpha(chunks).to_numpy(zero_copy_only=False)
        for own, work in ((letters, self._letters), (plain & ~letters, self._plain), (~plain, self._odd)):
            if own.any():
                part = chunks.filter(pa.array(own))
                flat, counts = work(part)
                first = len(self.start)
                self.held += pc.sum(pc.binary_length(part)).as_py()
                self.slot.update(zip(part.to_pylist(), range(first, first + len(counts)), strict=True))
                self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(counts) - counts])
                self.length = np.concatenate([self.length, counts])
                self.ids = np.concatenate([self.ids, flat])

    def _slots(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots of the texts' distinct chunks, the texts' chunks as places in that list, and where each text's begin."""
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        if len(self.slot) > self.room * self.max_chunks or self.held > self.room * MAX_CHUNK_BYTES:
            self.forget()
        known = np.fromiter(map(self.slot.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(known < 0)
        new = [chunks[i] for i in missing.tolist()]
        for i in range(0, len(new), LEARNT_AT_ONCE):
            self._learn(new[i : i + LEARNT_AT_ONCE])
        known[missing] = np.fromiter(map(self.slot.__getitem__, new), np.int64, len(new))
        offsets = lists.offsets.to_numpy()
        return known, coded.indices.to_numpy(), offsets - offsets[0]

    def _slices(self, texts: pa.Array):
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        for first, past in text_slices(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), int(self.room * SLICE_BYTES)):
            yield self._slots(pc.fill_null(texts.slice(first, past - first), ""))
            release()

    def encode(self, texts: pa.Array):
        """For slices of the texts: their ids, one text after the other, and where each text's begin and end."""
        for known, places, offsets in self._slices(texts):
            slots = known[places] if len(known) else known
            lengths = self.length[slots]
            bounds = np.concatenate([[0], np.cumsum(lengths)])[offsets]
            yield ragged_take(self.ids, self.start[slots], lengths), bounds

    def count(self, texts: pa.Array) -> np.ndarray:
        """The number of pieces of each text.

        A text's chunks become frequencies - rows (text, distinct chunk, times) - which are joined to the chunks'
        numbers of pieces and summed. No text's ids are built.
        """
        found = []
        for known, places, offsets in self._slices(texts):
            of, chunk, times = frequencies(places, offsets)
            found.append(np.bincount(of, weights=times * self.length[known[chunk]], minlength=len(offsets) - 1).astype(np.int64))
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def frequencies(places: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, piece, times) of every text's distinct pieces; text i has places[offsets[i] : offsets[i + 1]]."""
    if not len(places):
        return (np.zeros(0, np.int64),) * 3
    width = int(places.max()) + 1
    keys, times = np.unique(np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) * width + places, return_counts=True)
    return keys // width, keys % width, times


class _JsonPieces:
    """Pre-tokens of a tokenizers file and the number of pieces of each, by the file's own steps."""

    def __init__(self, library):
        self.library, self.normal, self.cut = library, library.normalizer, library.pre_tokenizer
        self.special = [t.content for t in library.get_added_tokens_decoder().values()]

    def split(self, text: str) -> list[str] | None:
        """The text's pre-tokens, or None if an added token may stand in it: then the library must see it whole."""
        plain = self.normal.normalize_str(text) if self.normal else text
        if any(s in text or s in plain for s in self.special):
            return None
        return [piece for piece, _ in self.cut.pre_tokenize_str(plain)] if self.cut else [plain]

    def sizes(self, pieces: list[str]) -> list[int]:
        return [len(self.library.model.tokenize(p)) if p else 0 for p in pieces]


class _ModelPieces:
    """The same for a SentencePiece model whose pieces hold blanks at their start only, so that words don't meet."""

    BLANK = "\u2581"

    def __init__(self, model):
        self.model, blank = model, self.BLANK
        across = re.compile(f"[^{blank}]{blank}")
        pieces = map(model.id_to_piece, range(model.vocab_size()))
        self.apart = not any(across.search(p) for p in pieces) and model.piece_to_id(blank) != model.unk_id() and model.normalize("x") == f"{blank}x"
        self.run = re.compile(f"{blank}*[^{blank}]+|{blank}+$")

    def split(self, text: str) -> list[str] | None:
        if not self.apart:
            return None
        found = self.run.findall(self.model.normalize(text))
        # a piece's own text must give it back, else the whole text is encoded
        return found if all(p.startswith(self.BLANK) for p in found) else None

    def sizes(self, pieces: list[str]) -> list[int | None]:
        texts = [p[1:].replace(self.BLANK, " ") for p in pieces]
        return [len(ids) if self.model.normalize(t) == p else None for t, p, ids in zip(texts, pieces, self.model.encode(texts, num_threads=1), strict=True)]


class TextEncoder:
    """The same for any tokenizer file: ids by encoding whole texts with its library, counts by distinct pre-tokens."""

    def __init__(self, path: str, max_pieces: int = MAX_CHUNKS):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._ids = lambda texts: model.encode(texts, num_threads=1)
            size, self.pieces = model.vocab_size(), _ModelPieces(model)
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.no_truncation()
            library.no_padding()
            self._ids = lambda texts: [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
            size, self.pieces = max(library.get_vocab().values()) + 1, _JsonPieces(library)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.max_pieces, self.room = max_pieces, 1
        self.forget()

    def forget(self) -> None:
        """Drop the table of pre-tokens."""
        self.sizes: dict[str, int | None] = {}
        self.held = 0

    def encode(self, texts: pa.Array):
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        for first, past in text_slices(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), SLICE_BYTES // 8):
            lists = self._ids(pc.fill_null(texts.slice(first, past - first), "").to_pylist())
            yield np.array([i for ids in lists for i in ids], self.dtype), np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])

    def _count(self, text: str) -> int:
        pieces = self.pieces.split(text)
        if pieces is not None:
            times = Counter(pieces)
            if len(self.sizes) > self.room * self.max_pieces or self.held > self.room * MAX_CHUNK_BYTES:
                self.forget()
            if new := [p for p in times if p not in self.sizes]:
                self.sizes.update(zip(new, self.pieces.sizes(new), strict=True))
                self.held += sum(map(len, new))
            if all(self.sizes[p] is not None for p in times):
                return sum(n * self.sizes[p] for p, n in times.items())
        return len(self._ids([text])[0])

    def count(self, texts: pa.Array) -> np.ndarray:
        """The number of pieces of each text: frequencies of its pre-tokens, joined to their numbers of pieces and summed."""
        return np.fromiter((self._count(t) for t in pc.fill_null(texts, "").to_pylist()), np.int64, len(texts))


def drops_white_space(path: str) -> bool:
    """Whether the file is of the family whose pre-tokens never hold a blank."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    steps = (told.get("pre_tokenizer") or {}).get("pretokenizers") or []
    split = steps[0] if steps else {}
    marks = (told.get("normalizer") or {}).get("normalizers") or []
    return (
        split.get("type") == "Split"
        and split.get("pattern") == {"Regex": WORD_PATTERN}
        and split.get("invert") is True
        and [m.get("type") for m in marks] == ["NFC", "Replace", "Lowercase"]
        and told["model"].get("end_of_word_suffix") == "</w>"
        and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"].startswith("<|") for t in told["added_tokens"])
    )


_ENCODERS: dict[str, WordEncoder | TextEncoder] = {}


def encoder(path: str) -> WordEncoder | TextEncoder:
    """This process's encoder for the tokenizer file."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = WordEncoder(path) if drops_white_space(path) else TextEncoder(path)
    return _ENCODERS[path]


@contextmanager
def task_encoder(path: str, room: float = 1):
    """The encoder for one task. Its bounded table serves the worker's next tokenising task; any other task drops it (`frugal`).

    With `room`, table and slices may be so many times larger: fewer chunks are learnt anew, for some 150 MB a worker each time.
    With a quarter a worker takes some 100 MB less and half as much time again.
    """
    known = encoder(path)
    known.room = room
    if not CACHES:
        CACHES.append(lambda: [e.forget() for e in _ENCODERS.values()])
    try:
        yield known
    finally:
        give_back()


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with `end_id` after each text, and the new bounds."""
    after = bounds + np.arange(len(bounds))
    out = np.empty(after[-1], ids.dtype)
    last = after[1:] - 1
    body = np.ones(len(out), bool)
    body[last] = False
    out[body] = ids
    out[last] = end_id
    return out, after
