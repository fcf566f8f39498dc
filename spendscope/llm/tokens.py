"""Token ids of public tokenizers.

The tokenizer is a file of the ``tokenizers`` library, given by path. Where the file is
plain byte-level BPE, texts of ASCII and Latin letters are encoded from the same
vocabulary by ``tiktoken``, several times as fast and with the same ids; other texts, and
those that hold a special token, go to the tokenizer itself.
"""

from __future__ import annotations

import json
import os
import re
import sys

import numpy as np

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"[\t\n\r -~{_LETTERS}]*")
_SPACES = re.compile(r"\s\s|\s\Z")
#: how byte-level BPE cuts texts that _PLAIN matches and _SPACES is not in
_PIECES = f"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s0-9{_LETTERS}]+|\\s"


def encoder(path: str) -> Encoder:
    """The encoder of a file, loaded once for each Python worker: functions are sent by
    value, so a module's own variables would not outlive a task."""
    kept = sys.__dict__.setdefault("_llm_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


class Encoder:
    """``encode`` gives the ids of a text as an array of unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = self._byte_level(path)

    def _byte_level(self, path: str):
        """The quick encoder; None where the file is not byte-level BPE with ids in the
        order of its merges."""
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if (model.get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space")
                or not pre.get("use_regex", True) or spec.get("normalizer") or model.get("dropout")
                or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")):
            return None
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [model["vocab"]["".join(m)] for m in merges]
        if not ids or ids[0] < 256 or ids != sorted(ids):
            return None
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [c for c in range(256) if c not in shown]
        byte = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(hidden)}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in self.special}
        return tiktoken.Encoding("file", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, dtype="<u4")
        if (self.plain and _PLAIN.fullmatch(text) and not _SPACES.search(text)
                and not any(s in text for s in self.special)):
            return np.array(self.plain(text), dtype="<u4")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
