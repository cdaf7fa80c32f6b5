"""Byte-level BPE from a tokenizer's JSON file: vocabulary, pre-tokens and merge checks."""

from __future__ import annotations

import json

import regex

#: The pre-token pattern of byte-level BPE tokenizers with use_regex.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in such files, by rule:
    printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """What a byte_bpe JSON file says: token bytes to ids, merge ranks and special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.vocab = {raw(t): i for t, i in model["vocab"].items() if t not in self.special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank = {(raw(a), raw(b)): r for r, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.vocab))
        self.pieces = regex.compile(PRETOKEN).findall
        self.split_special = regex.compile("|".join(f"({regex.escape(s)})" for s in sorted(self.special, key=len, reverse=True))).split if self.special else None

        self.made = {a + b: (a, b) for a, b in self.rank}
        self.edges: dict[tuple[bytes, int], list[tuple[bytes, int, int]]] = {}

    def edge(self, token: bytes, side: int) -> list[tuple[bytes, int, int]]:
        """The parts of a token that stand at its left (0) or right (1) end while BPE makes it:
        each with the rank of the merge that made it and of the one that used it up."""
        found = self.edges.get((token, side))
        if found is None:
            found, at, used = [], token, 1 << 30
            while at in self.made:
                made = self.rank[self.made[at]]
                found.append((at, made, used))
                at, used = self.made[at][side], made
            found.append((at, -1, used))
            self.edges[token, side] = found
        return found

    def apart(self, left: bytes, right: bytes) -> bool:
        """Whether BPE of left + right leaves just these tokens: no pair that ever
        stands at the border has a rank at which both of its parts are there.
        At equal rank the leftmost pair goes first."""
        rank = self.rank
        for b, b_made, b_used in self.edge(right, 0):
            for a, a_made, a_used in self.edge(left, 1):
                r = rank.get((a, b))
                if r is not None and a_made < r < a_used and b_made < r <= b_used:
                    return False
        return True

    def merge(self, word: bytes) -> list[bytes]:
        """Plain BPE: the pair of lowest rank, leftmost first, until none merges."""
        parts = [word[i : i + 1] for i in range(len(word))]
        rank = self.rank
        while len(parts) > 1:
            best = min((rank.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:])))
            if best[0] == 1 << 30:
                break
            pair = (parts[best[1]], parts[best[1] + 1])
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts
