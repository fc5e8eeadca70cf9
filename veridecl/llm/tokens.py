"""Token ids of texts from the files of public tokenizers."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np


@functools.cache
def load(path: str) -> tuple[Callable[[str], np.ndarray], np.ndarray]:
    """An encoder for a byte-level BPE file of the tokenizers library, and which ids end a sentence.

    Texts are encoded without special tokens being added; the strings of special tokens inside a text get their ids,
    as that library does by itself. Where the file is a plain byte-level BPE, its merge ranks are run by tiktoken,
    which gives the same ids several times faster.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    size = tokenizer.get_vocab_size()
    ends = np.zeros(size, bool)
    for i in range(size):
        piece = tokenizer.decode([i], skip_special_tokens=False)
        ends[i] = piece.rstrip()[-1:] in (".", "!", "?") or "\n" in piece
    return _fast(path, tokenizer) or (lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.int64)), ends


def _fast(path: str, tokenizer) -> Callable[[str], np.ndarray] | None:
    import json

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    plain = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
    kind = {k: v for k, v in (spec.get("pre_tokenizer") or {}).items() if k != "use_regex"}
    special = spec.get("added_tokens") or []
    bare = all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in special)
    if kind != plain or spec.get("normalizer") or spec["model"]["type"] != "BPE" or not bare:
        return None
    import tiktoken

    # byte-level files write each byte as one printable character
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    names = {t["content"]: t["id"] for t in special}
    ranks = {bytes(byte[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in names}
    # the pattern of byte-level BPE: contractions, letters, numbers, others, white space
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    encoding = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=names)

    def encode(text: str) -> np.ndarray:
        return encoding.encode_to_numpy(text, allowed_special="all", disallowed_special=())

    return encode
