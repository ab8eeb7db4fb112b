"""Token ids of whole texts by a public byte-level tokenizer, taken from its ranks where that is faster."""

from __future__ import annotations

import base64
import os
import re

import numpy as np

#: Characters on whose classes all pattern libraries agree, without other white space.
_PLAIN = re.compile(r"[\n\x20-\x7e\xa1-\xac\xae-ɏ]*")


class Encoder:
    """Ids of texts, equal to those of the tokenizer file over the whole text.

    ``ranks`` is a file of the same vocabulary as ranks; texts of plain characters that hold no
    special token are encoded by it, all others by the tokenizer file.
    """

    def __init__(self, path: str, ranks: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                found = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=found, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        """The ids of ``text`` without special tokens."""
        if self.fast is None or _PLAIN.fullmatch(text) is None or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)
