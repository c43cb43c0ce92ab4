"""Token counts: exact number of tokens of every prefix of a text.

The table is made by dynamic programming over prefixes.  Within a pre-token the
last token of the encoding of a prefix is the one token t that ends there and is
a valid neighbour of the last token of the prefix before t; so each prefix costs
a few look-ups, and its count is one more than that of the prefix before t.
A text is cut where white space follows something else, since no pre-token
crosses such a place and what comes later never changes what came before; the
counts of such a unit depend on its characters alone and are kept for reuse.

The stored form is one small integer per character: the change of the count.
Their running sum is the count at every prefix, so truncation and budget
questions are answered from the table, without encoding again.

Null text counts as empty text: no bytes, no tokens, an empty table.  Texts of any
length are counted whole, unit by unit.  Null ids are kept.  Repeated rows give equal
rows; no rows give none.  Columns other than the id and the text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelab.llm.runtime import arrow_map

#: Unicode White_Space, fixed values: what the byte-level pre-tokenizer takes for space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNIT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_LEAD = re.compile(f"[{WHITE}]*")

#: Characters whose class (letter, digit, space, other) no Unicode version disputes.
_LETTERS, _OTHER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff", "!-/:-@\\[-`{-~\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7"
_SAFE = re.compile(f"[\t-\r 0-9{_LETTERS}{_OTHER}]*")
#: Cuts a text of such characters into pre-tokens; two spaces or more stay with what follows.
_PIECE = re.compile(
    f"[\t-\r ][\t-\r ]+(?:'[^\t-\r ]*|[{_LETTERS}]+|[0-9]+|[{_OTHER}]+)?"
    f"|'(?:[sdmt]|ll|ve|re)| ?[{_LETTERS}]+| ?[0-9]+| ?[{_OTHER}]+|[\t-\r ]"
)


class PrefixCounter:
    """Counts for one byte-level BPE tokenizer file."""

    def __init__(self, path: str, keep: int = 500_000):
        from tokenizers import Tokenizer

        import json

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        self.ids: dict[str, int] = {k: v for k, v in spec["model"]["vocab"].items()}
        self.names = {v: k for k, v in self.ids.items()}
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
        self.longest = max(map(len, self.ids))
        if self.longest > 128:
            raise ValueError("a token of over 128 bytes: changes of the count need not fit one byte")
        self.begins = {k[:i] for k in self.ids for i in range(1, len(k) + 1)}
        self.keep, self.units = keep, {}
        self.infos, self.nodes, self.pairs = {}, {"": {"": ""}}, 0
        # the vocabulary writes each byte as one printable character
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(shown)]
        self.symbol = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def merge(self, symbols: list[str]) -> list[str]:
        """The encoding by definition: the merge of lowest rank first, leftmost first."""
        rank, none = self.rank, 1 << 60
        while len(symbols) > 1:
            ranks = [rank.get(p, none) for p in zip(symbols, symbols[1:])]
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def info(self, token: str) -> list:
        """Of a token: itself, its length, which tokens may come before it (as far as known), and the
        longest shorter token that it ends with (False until asked for)."""
        if token not in self.infos:
            self.infos[token] = [token, len(token), {}, False]
        return self.infos[token]

    def neighbours(self, before: str, info: list) -> bool:
        """Whether a token can follow another one: their joint text is encoded as just these two."""
        token, _, known, _ = info
        v = known[before] = self.merge(list(before + token)) == ([before, token] if before else [token])
        self.pairs += 1
        return v

    def shorter(self, info: list) -> list:
        token = info[0]
        for k in range(1, len(token)):
            if token[k:] in self.ids:
                info[3] = self.info(token[k:])
                return info[3]
        raise ValueError(f"the vocabulary doesn't cover {token!r}")

    def step(self, node: dict, symbol: str) -> tuple[dict, list]:
        """Next state of the suffix automaton, made when first needed.  A state is the longest suffix that
        begins a token; with it goes the longest token that ends here."""
        state = node[""] + symbol
        while state and state not in self.begins:
            state = state[1:]
        token = state
        while token and token not in self.ids:
            token = token[1:]
        if not token:
            raise ValueError(f"the vocabulary doesn't cover {symbol!r}")
        if state not in self.nodes:
            self.nodes[state] = {"": state}
        node[symbol] = out = (self.nodes[state], self.info(token))
        return out

    def counts(self, s: str) -> list[int]:
        """Number of tokens at every prefix of one pre-token, given as byte symbols; entry 0 is the empty prefix."""
        if self.pairs > 8 * self.keep:
            self.infos, self.nodes, self.pairs = {}, {"": {"": ""}}, 0
        node, last, n, i = self.nodes[""], [""], [0], 0
        for symbol in s:
            i += 1
            node, info = node.get(symbol) or self.step(node, symbol)
            while True:
                token, size, known, less = info
                before = last[i - size]
                v = known.get(before)
                if v or v is None and self.neighbours(before, info):
                    break
                info = less or self.shorter(info)
            last.append(token)
            n.append(n[i - size] + 1)
        return n

    def pretokens(self, text: str) -> list[tuple[str, int, int]]:
        return [(p, a, b) for p, (a, b) in self.split(text)]

    def plain(self, text: str, partial: bool = True) -> list[int]:
        """Counts at every prefix of a text without special tokens, by character, entry 0 for the empty prefix."""
        lead, out, base = _LEAD.match(text).end(), [0], 0
        if lead:  # a prefix that ends within leading white space is one pre-token
            n = self.counts("".join(p for p, _, _ in self.pretokens(text[:lead])))
            ends = np.cumsum([len(c.encode()) for c in text[:lead]])
            out += [n[e] for e in ends]
        for p, a, b in self.pretokens(text):
            n = self.counts(p)
            if b > lead:
                if b - a == len(p):
                    part = n[1:]
                else:
                    part = [n[e] for e in np.cumsum([len(c.encode()) for c in text[a:b]])]
                if b - a == 3 and text[a] == "'":  # 'll, 've, 're: two pre-tokens before the last letter
                    part[1] = 2 if text[a + 1 : b] in ("ll", "ve", "re") else part[1]
                out += [base + x for x in part[max(0, lead - a) :]]
            base += n[-1]
        return out

    def unit(self, text: str) -> list[int]:
        """Counts at every prefix of a unit, where special tokens' strings count as one token once complete."""
        if not self.special.search(text):
            return self.plain(text)
        out, base, at = [0], 0, 0
        for m in self.special.finditer(text):
            before = text[at : m.start()]
            n = self.plain(before)
            out += [base + x for x in n[1:]]
            # an unfinished special string is ordinary text, and continues the last pre-token before it
            a = self.pretokens(before)[-1][1] if before else 0
            tail = self.plain(before[a:] + m[0])
            shift = n[-1] - self.plain(before[a:])[-1]
            out += [base + shift + x for x in tail[len(before) - a + 1 : -1]]
            base += n[-1] + 1
            out.append(base)
            at = m.end()
        return out + [base + x for x in self.plain(text[at:])[1:]]

    def piece(self, text: str) -> bytes:
        """The changes of the count within one match of _PIECE."""
        if text[0].isspace() and len(text) > 1 and text[1].isspace():
            n = self.plain(text)
        elif text[0] == "'" and text[1:] in ("ll", "ve", "re"):
            n = self.plain(text)
        else:
            data = text.encode()
            n = self.counts(data.decode("latin-1").translate(self.symbol))
            if len(data) != len(text):  # keep the prefixes that end with a whole character
                n = [n[i] for i, b in enumerate(data) if b & 0xC0 != 0x80] + n[-1:]
        return bytes([(b - a) & 255 for a, b in zip(n, n[1:])])

    def deltas(self, text: str) -> bytes:
        """The changes of the count, one signed byte per character."""
        safe = _SAFE.fullmatch(text) is not None and not self.special.search(text)
        found = (_PIECE if safe else _UNIT).findall(text)
        units = self.units
        try:
            return b"".join(map(units.__getitem__, found))
        except KeyError:
            parts = []
            for u in found:
                d = units.get(u)
                if d is None:
                    if len(units) >= self.keep:
                        units.clear()
                    if safe:
                        d = self.piece(u)
                    else:
                        n = self.unit(u)
                        d = bytes([(b - a) & 255 for a, b in zip(n, n[1:])])
                    if len(u) <= 64:
                        units[u] = d
                parts.append(d)
            return b"".join(parts)


def prefix_counts(deltas: bytes) -> np.ndarray:
    """The stored row as counts: entry k is the number of tokens of the first k characters."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(deltas, np.int8).astype(np.int64))])


def prefix_table(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, n_bytes (UTF-8), n_tokens of the whole
    text, and prefix_deltas, the stored table.  `tokenizer` names a byte-level
    BPE file of the public tokenizers, or is the path of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(_path(tokenizer))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [counter.deltas(t) if t else b"" for t in texts]
            # the whole text's count is the sum of the changes
            n = [int(np.frombuffer(d, np.int8).sum(dtype=np.int64)) for d in rows]
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(rows, pa.binary())],
                names=["id", "n_bytes", "n_tokens", "prefix_deltas"],
            )

    ids = docs.schema[id_col].dataType.simpleString()
    out = arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {ids}, n_bytes long, n_tokens long, prefix_deltas binary")
    return out.withColumnRenamed("id", id_col)


def _path(tokenizer: str) -> str:
    if "/" in tokenizer:
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def answer_budget(table: DataFrame, budget: int) -> DataFrame:
    """From a stored table: fits (whole text within the budget) and
    longest_prefix, the most characters whose tokens stay within the budget."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = []
            for d in batch.column("prefix_deltas").to_pylist():
                ok = np.flatnonzero(prefix_counts(d) <= budget)
                best.append(int(ok[-1]) if len(ok) else 0)
            yield batch.append_column("longest_prefix", pa.array(best, pa.int64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
    return arrow_map(table, run, f"{fields}, longest_prefix long").withColumn("fits", F.col("n_tokens") <= budget)


def over_limit(limit: int) -> Column:
    return F.col("n_tokens") > limit
