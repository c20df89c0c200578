"""Byte-pair encoding by a streaming transducer with bounded lookahead, and decoding by a byte-to-text machine.

The transducer reads a word's symbols one at a time. For each prefix it keeps the only token that can end the
prefix's encoding: the token t of length n such that the pair (last token of the prefix without t, t) is stable,
which means that merging both tokens' symbols afresh gives the same two tokens. Following these tokens back from
any point gives the encoding up to there. A later symbol can change it only within the merge list's sufficient
lookahead, which ``sufficient_lookahead`` computes; what lies further back is emitted, so a window of fixed size
is all that is kept, however long the word.

Lookahead: let rule j (u, v) be undone by an earlier rule i whose left part is a suffix of v's text; that needs
the text of i's right part, and i itself may be undone by a still earlier rule. The sum of the right parts'
lengths along the longest such chain is enough.

Defined cases: a null text is the empty one, without tokens. Special tokens in a text are cut out first and
become one token each, as the reference library does. Texts of any length take the same memory beside their ids.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from factloom.llm.common import TwoAgeCache, free_name

END = "</w>"
#: White space by Unicode's property; Python's own notion adds the separators U+001C to U+001F.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = regex.compile(f"[{WHITE}]+")
SEPARATORS = regex.compile("[\x1c-\x1f]")
RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


@lru_cache(1)
def byte_letters() -> list[str]:
    """The letter for each byte value: printable ones stand for themselves, others get letters from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, free = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(free)
            free += 1
    return [letters[b] for b in range(256)]


class Merges:
    """The merge list over symbols; a symbol is a letter, or a letter and the end mark."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = END):
        self.vocab, self.end = vocab, end
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.lookahead = self.sufficient_lookahead(merges)
        tokens = {u + v for u, v in merges}
        self.longest = max(map(self.length, tokens), default=1)
        #: Texts that end a token; a longer text whose end isn't among them is none.
        self.ends = {t[k:] for t in tokens for k in range(len(t))}
        self.made: dict[str, tuple[int, str, str] | None] = {}
        self.pairs = TwoAgeCache(lambda pair: self.stable(*pair), 200_000)

    def length(self, token: str) -> int:
        return len(token.removesuffix(self.end)) if self.end else len(token)

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end):
            body = token.removesuffix(self.end)
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def sufficient_lookahead(self, merges: list[tuple[str, str]]) -> int:
        """Symbols after a token's end that can have a say in it; see the module's text."""
        best: dict[str, int] = {}
        most = 1
        for u, v in merges:  # the earliest first
            size = self.length(v)
            reach = size + max((best.get(v[k:], 0) for k in range(len(v))), default=0)
            best[u] = max(best.get(u, 0), reach)
            most = max(most, reach)
        return most

    def merged(self, symbols: list[str], steps: list | None = None) -> list[str]:
        """The encoding by its definition: the earliest rule that fits, leftmost first, until none does."""
        rank, parts = self.rank, list(symbols)
        while len(parts) > 1:
            at = min(range(len(parts) - 1), key=lambda k: rank.get((parts[k], parts[k + 1]), 1 << 60))
            pair = (parts[at], parts[at + 1])
            if pair not in rank:
                break
            if steps is not None:
                steps.append((rank[pair], *pair))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def last_merge(self, token: str) -> tuple[int, str, str] | None:
        """The merge that makes ``token`` out of its own symbols: (rank, left, right).

        A single symbol has rank -1. None: merging its symbols doesn't give this token, so it never occurs.
        """
        if token not in self.made:  # at most as many as there are tokens
            steps: list[tuple[int, str, str]] = []
            whole = token in self.vocab and self.merged(self.symbols(token), steps) == [token]
            self.made[token] = (steps[-1] if steps else (-1, "", "")) if whole else None
        return self.made[token]

    def stable(self, left: str | None, right: str) -> bool:
        """Whether merging the symbols of both tokens together gives these two tokens.

        The merges beside the border are undone, the latest first. If the border's neighbours at some time had a rule
        that comes before the merge undone last, they would have been merged instead. Of equal rules the left one comes
        first: the border's rule beats an equal one to its right but not one to its left.
        """
        rank, before = self.rank, 1 << 60
        if left is None or self.last_merge(right) is None:
            return False
        while True:
            if rank.get((left, right), 1 << 60) < before:
                return False
            (a, _, inner_left), (b, inner_right, _) = self.last_merge(left), self.last_merge(right)
            if a < 0 and b < 0:
                return True
            if a > b:
                before, left = a, inner_left
            else:
                before, right = b + 1, inner_right


class Transducer:
    """Tokens of a word, emitted as soon as they can't change."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.window = merges.lookahead + 2 * merges.longest

    def tokens(self, symbols: Iterable[str]) -> Iterator[str]:
        """``symbols``: letters, the last of which has the end mark. Memory: a window of symbols and tokens."""
        ends, vocab, pairs, last_merge = self.merges.ends, self.merges.vocab, self.merges.pairs, self.merges.last_merge
        kept: list[str] = []  # symbols since the last token emitted
        last: list[str | None] = []  # the token that ends the encoding up to and with each of them
        for symbol in symbols:
            kept.append(symbol)
            n = len(kept)
            token, found, at = symbol, None, n - 1
            while True:
                if token in vocab:
                    if at == 0:
                        found = token if last_merge(token) is not None else None
                        break
                    if pairs[last[at - 1], token]:
                        found = token
                        break
                if at == 0:
                    break
                at -= 1
                token = kept[at] + token
                if token not in ends:
                    break
            last.append(found)
            if n >= 2 * self.window:
                done = self._back(kept, last, n - self.merges.lookahead)
                yield from done
                cut = sum(map(self.merges.length, done))
                # the first token kept has a stable left neighbour from now on: the one just emitted
                del kept[:cut], last[:cut]
        yield from self._back(kept, last, len(kept))

    def _back(self, kept: list[str], last: list[str | None], upto: int) -> list[str]:
        """The tokens that the encoding of all of ``kept`` has before ``upto``."""
        at, out = len(kept), []
        while at > 0:
            token = last[at - 1]
            if token is None:
                raise ValueError("the merge list has no encoding for these symbols")
            if at <= upto:
                out.append(token)
            at -= self.merges.length(token)
        return out[::-1]


class Text:
    """Incremental decoding: bytes of any split to text, an invalid sequence giving the replacement sign."""

    def __init__(self):
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, piece: bytes, final: bool = False) -> str:
        return self.machine.decode(piece, final)


class WordTokenizer:
    """Encoding and decoding as the tokenizer file says: NFC, white space, lower case, words, bytes, merges."""

    def __init__(self, path: str, cache: int = 300_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(x) if not isinstance(x, str) else tuple(x.split(" ")) for x in model["merges"]]
        self.merges = Merges(self.vocab, merges, model["end_of_word_suffix"] or "")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")")
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", WHITE))
        self.transducer = Transducer(self.merges)
        self.token_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.chunks = TwoAgeCache(self._chunk, cache)
        self.plain = [self.token_of.get(i, "").encode() for i in range(max(self.token_of) + 1)]

    def _word(self, word: str) -> Iterator[int]:
        letters, data = byte_letters(), word.encode("utf-8", "surrogatepass")
        symbols = (letters[b] if k + 1 < len(data) else letters[b] + self.merges.end for k, b in enumerate(data))
        return (self.vocab[t] for t in self.transducer.tokens(symbols))

    def _chunk(self, chunk: str) -> bytes:
        """The ids, as little-endian 32-bit integers, of a text without white space."""
        out: list[int] = []
        for word in self.words.findall(chunk):
            out.extend(self._word(word))
        return np.array(out, dtype="<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text, as little-endian 32-bit integers."""
        text, out, chunks = text or "", [], self.chunks
        if "<|" not in text:
            parts = [text]
        else:
            parts = self.specials.split(text)
        for part in parts:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            clean = part if part.isascii() else SPACE.sub(" ", unicodedata.normalize("NFC", part))
            # words never span white space; long chunks, which are rare, pass by the cache
            clean = lower(clean)
            some = SPACE.split(clean) if SEPARATORS.search(clean) else clean.split()
            if max(map(len, some), default=0) <= 64:
                out.extend(map(chunks.__getitem__, some))
            else:
                out.extend(chunks[x] if len(x) <= 64 else self._chunk(x) for x in some)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The tokens' texts with a space between them, as the library joins them where a file names no decoder."""
        machine, plain = Text(), self.plain
        numbers, pieces = np.frombuffer(ids, dtype="<u4").tolist(), []
        for at in range(0, len(numbers), 65536):
            some = b" ".join(map(plain.__getitem__, numbers[at : at + 65536]))
            pieces.append(machine.feed(some if at == 0 else b" " + some))
        pieces.append(machine.feed(b"", True))
        return "".join(pieces)


def lower(text: str) -> str:
    """Lower case letter by letter, without regard to neighbours: a final sigma isn't special."""
    return text.lower() if "Σ" not in text else "σ".join(x.lower() for x in text.split("Σ"))


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each path and Python process."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ``ids`` (array<int>) and ``decoded`` for every row of ``docs``; columns that have these names are replaced.

    A null text counts as empty. Repeated rows are encoded each; an empty table gives no rows.
    """
    kept = [f for f in docs.schema if f.name.lower() not in ("ids", "decoded")]
    value = free_name(docs.columns, "_text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = tokenizer(path)
        for batch in batches:
            ids = [own.encode(x) for x in batch[value]]
            yield batch.drop(columns=value).assign(ids=[np.frombuffer(x, dtype="<i4") for x in ids], decoded=[own.decode(x) for x in ids])

    rows = docs.select(*[docs[f.name] for f in kept], docs[text].alias(value))
    return rows.mapInPandas(run, f"{schema}{', ' if kept else ''}ids array<int>, decoded string")


def digest_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text, for every row of ``docs``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = tokenizer(path)
        for batch in batches:
            rows = []
            for value in batch["_text"]:
                ids = own.encode(value)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()))
            yield pd.DataFrame({"doc_id": batch["_id"]}).assign(**dict(zip(["n_tokens", "ids_sha256", "decoded_sha256"], zip(*rows), strict=False)))

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(docs[id_column].alias("_id"), docs[text].alias("_text"))
    return rows.mapInPandas(run, f"doc_id {kind}, {RESULT}")
