"""Tokenizer files, and encoding that pays for a piece of text once per worker.

Two kinds of tokenizer never merge across white space in a way that depends on anything outside a
piece, so a text's ids are its pieces' ids one after the other:

* byte-level BPE without normaliser: a token may begin with white space but never spans a change
  from other characters to white space, so pieces are runs of spaces or line ends with what follows;
* word BPE that drops white space: pieces are what spaces and line ends separate. A text of Latin-1 is
  set in lower case beforehand. A plain word goes to the tokenizer's model alone, as neither the
  normaliser nor the pattern would change or cut it; punctuation behind it is a piece of its own.

Only spaces and line ends separate pieces; a text of the first kind with any other white space is
encoded whole, and so is every text of a tokenizer of another kind. Pieces are kept in two
generations of at most about `PIECES` each (and none of over `PIECE_CHARS`); when the younger is full it becomes the older one.
"""

import hashlib
import json
import os
import re
import string
from array import array

PIECES, PIECE_CHARS, AT_ONCE = 600_000, 64, 50
_ENCODERS: dict = {}

_LED = re.compile(r"[ \n]*[^ \n]+|[ \n]+").findall
_OTHER_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]").search
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What may end a piece and is one run to `_WORDS`. An apostrophe may begin one of its endings.
_TAIL = "".join(c for c in string.punctuation if c != "'")


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def version_of(path: str) -> str:
    """Digest of the tokenizer's file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _kind(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].isalpha() for t in spec.get("added_tokens", []))
    if plain and not norm and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "led"
    steps = [n.get("type") for n in norm.get("normalizers", [])]
    first, *others = pre.get("pretokenizers", [{}])
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
    cuts = drops and first.get("pattern", {}).get("Regex") == _WORDS
    bytewise = [(o["type"], o.get("add_prefix_space"), o.get("use_regex")) for o in others] == [("ByteLevel", False, False)]
    if plain and steps == ["NFC", "Replace", "Lowercase"] and cuts and bytewise:
        return "words"
    return "whole"


class _Known(dict):
    """What is known of pieces. A missing one is taken from the generation before, else made."""

    def __init__(self, make, before: dict):
        self.make, self.before = make, before

    def __missing__(self, piece: str):
        found = self.before.get(piece)
        if found is None:
            found = self.make(piece)
        if len(piece) <= PIECE_CHARS:
            self[piece] = found
        return found


class Encoder:
    """Ids or counts of whole texts, as the library gives them without added special tokens."""

    def __init__(self, path: str, counts: bool):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.kind, self.counts = _kind(path), counts
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.old: dict = {}
        self.young: dict = _Known(self._word, self.old) if self.kind == "words" else {}
        self.tokens_of = self.tokenizer.model.tokenize
        self.spelt = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _encode(self, pieces: list[str]) -> list:
        found = self.tokenizer.encode_batch(pieces, add_special_tokens=False) if pieces else []
        return [len(e) for e in found] if self.counts else [array("I", e.ids).tobytes() for e in found]

    def _word(self, piece: str):
        """Of a piece that is not known. Of a plain word with punctuation behind, the lower-case word and
        the rest are looked up apart: the tokenizer does the same."""
        base = piece.rstrip(_TAIL)
        if not (base.isalpha() and (base.isascii() or max(base) < "\u0250" and "\u0130" not in base)):
            return self._encode([piece])[0]
        word = base.lower()
        if word != piece:
            return self.young[word] + self.young[piece[len(base):]]
        found = self.tokens_of(word if word.isascii() else self.spelt(word)[0][0])
        return len(found) if self.counts else array("I", [t.id for t in found]).tobytes()

    def _lower(self, text: str) -> str:
        """In lower case where that changes no id: the characters of Latin-1 are lowered one by one and
        never composed, but an added token is one only as it is written."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        low = text.lower()
        return text if any(a in low for a in self.added) else low

    def pieces(self, text: str) -> list[str]:
        if self.kind == "words":
            return self._lower(text).replace("\n", " ").split(" ")
        if self.kind == "led" and not _OTHER_SPACE(text):
            return _LED(text)
        return [text]

    def _joined(self, found):
        return sum(found) if self.counts else b"".join(found)

    def _by_word(self, text: str):
        found = self._joined(map(self.young.__getitem__, self.pieces(text)))
        if len(self.young) > PIECES:
            self.old, self.young = self.young, _Known(self._word, self.young)
            self.old.before = {}
        return found

    def _some(self, texts: list[str]) -> list:
        if self.kind == "words":
            return list(map(self._by_word, texts))
        known, held, missing = self.young, [], set()
        for text in texts:
            parts = self.pieces(text)
            found = list(map(known.get, parts))
            holes = [i for i, x in enumerate(found) if x is None] if None in found else []
            missing.update(parts[i] for i in holes)
            held.append((parts, found, holes))
        fresh = {p: self.old[p] for p in missing if p in self.old}
        new = [p for p in missing if p not in fresh]
        fresh.update(zip(new, self._encode(new)))
        for parts, found, holes in held:
            for i in holes:
                found[i] = fresh[parts[i]]
        known.update((p, x) for p, x in fresh.items() if len(p) <= PIECE_CHARS)
        if len(known) > PIECES:
            self.old, self.young = known, {}
        return [self._joined(found) for _, found, _ in held]

    def encode_all(self, texts: list[str]):
        """For each text the number of tokens, or the ids as little-endian unsigned 32-bit numbers."""
        for k in range(0, len(texts), AT_ONCE):
            yield from self._some(texts[k:k + AT_ONCE])

    def encode(self, text: str):
        return self._some([text])[0]


def encoder(path: str, counts: bool) -> Encoder:
    """One per Python worker."""
    key = path, counts
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, counts)
    return _ENCODERS[key]
