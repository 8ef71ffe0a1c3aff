"""Token ids of whole texts and the bytes of each id, for byte-level and for piece vocabularies.

A byte-level vocabulary is read from its JSON file. When its ids are the order of its merges, which is looked up, texts of
Latin letters are encoded by rank, several times faster; what holds other characters is left to the library, whose
character classes may be newer, in segments: white space and what follows it up to the next white space. The
vocabulary's pattern cuts a text before anything is merged, and no alternative of it goes on over white space that
follows another character, nor looks beyond it, so the ids of a text are those of its segments.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from itertools import groupby

import numpy as np

SPACE_MARK = "▁"
# How byte-level vocabularies of this kind cut texts. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BEYOND_LATIN = re.compile("[^\x00-ɏ‐-‧€]")
_SEGMENT = re.compile("(?<=[^\\s᠎])(?=[ \n])")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Vocabulary:
    """Ids (16 bits) of texts, and the bytes of each id."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], token_bytes: list[bytes]):
        if len(token_bytes) > 1 << 16:
            raise ValueError("more ids than 16 bits hold")
        self.encode_whole = encode
        self.bytes = token_bytes
        self.lengths = np.array([len(b) for b in token_bytes], np.int64)
        self.decimals = [str(i).encode() for i in range(len(token_bytes))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, "<u2") for ids in self.encode_whole(texts)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


def _rank_encoder(read: dict, token_bytes: list[bytes]) -> Callable[[str], list[int]] | None:
    """Encodes by rank where each merge makes the next id; None for other vocabularies."""
    import tiktoken

    added = {token["id"] for token in read["added_tokens"]}
    merges = [pair if isinstance(pair, list) else pair.split(" ") for pair in read["model"]["merges"]]
    vocab = read["model"]["vocab"]
    if any(vocab.get("".join(pair)) != 256 + at for at, pair in enumerate(merges)):
        return None
    ranks = {b: i for i, b in enumerate(token_bytes) if i not in added}
    if len(ranks) != 256 + len(merges):
        return None
    return tiktoken.Encoding("by rank", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def byte_level(path: str, special: bool) -> Vocabulary:
    """A byte-level vocabulary; ``special``: special tokens' strings in a text are those tokens, else plain text."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        read = json.load(file)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = not special
    of_letter = {letter: byte for byte, letter in enumerate(byte_letters())}
    names = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]
    token_bytes = [bytes(of_letter[c] for c in n) if all(c in of_letter for c in n) else n.encode() for n in names]
    by_rank = _rank_encoder(read, token_bytes)
    marks = [token["content"] for token in read["added_tokens"]] if special else []

    def hard(text: str) -> bool:
        return by_rank is None or _BEYOND_LATIN.search(text) is not None or any(mark in text for mark in marks)

    def encode(texts: list[str]) -> list[list[int]]:
        found: list = []
        left: list[str] = []
        for text in texts:
            if not hard(text):
                found.append([by_rank(text)])
                continue
            runs = []
            for is_hard, segments in groupby(_SEGMENT.split(text), hard):
                run = "".join(segments)
                runs.append(len(left) if is_hard else by_rank(run))
                if is_hard:
                    left.append(run)
            found.append(runs)
        by_library = [e.ids for e in tokenizer.encode_batch_fast(left, add_special_tokens=False)] if left else []
        return [runs[0] if len(runs) == 1 and not isinstance(runs[0], int)
                else [i for run in runs for i in (by_library[run] if isinstance(run, int) else run)] for runs in found]

    return Vocabulary(encode, token_bytes)


def piece_level(path: str) -> Vocabulary:
    """A vocabulary of pieces with byte fallback; texts are given with the space that the model adds itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    token_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
    return Vocabulary(lambda texts: model.encode([text[1:] for text in texts], num_threads=1), token_bytes)


_read: dict[tuple, Vocabulary] = {}


def vocabulary(kind: str, name: str, special: bool = False) -> Vocabulary:
    """One for each Python worker, kept for its later tasks. ``name``: a path, or a file of the installed public tokenizers."""
    key = (kind, name, special)
    if key not in _read:
        path = name
        if "/" not in name:
            import public_tokenizers

            path = public_tokenizers.path(name)
        _read[key] = byte_level(path, special) if kind == "bytes" else piece_level(path)
    return _read[key]
