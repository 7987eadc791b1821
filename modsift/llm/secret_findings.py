"""Labelled findings for the secret scan: lines of known forms, with the secrets in them named.

Every form is a rule for a line and says which of its runs are secrets.  The values come from a hash of form and
number, so the table is the same in every run; it has ``per_form`` lines of each form, whatever the corpus.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable

PER_FORM = 160
LETTERS = "abcdefghijklmnopqrstuvwxyz"
ALNUM = LETTERS + LETTERS.upper() + "0123456789"


class Draw:
    """Values from the hash of a form and a number."""

    def __init__(self, form: str, i: int, words: list[str]):
        self.seed, self.used, self.words = f"{form}:{i}", 0, words

    def number(self, below: int) -> int:
        self.used += 1
        return int.from_bytes(hashlib.sha256(f"{self.seed}:{self.used}".encode()).digest()[:8], "big") % below

    def pick(self, options):
        return options[self.number(len(options))]

    def text(self, n: int, alphabet: str = ALNUM) -> str:
        return "".join(self.pick(alphabet) for _ in range(n))

    def hex(self, n: int) -> str:
        return self.text(n, "0123456789abcdef")

    def encoded(self, n: int) -> str:
        raw = hashlib.sha512(f"{self.seed}:{self.number(1 << 40)}".encode()).digest()
        return base64.b64encode(raw).decode()[:n]

    def word(self) -> str:
        return self.pick(self.words)

    def joined(self, least: int, by: str = "") -> str:
        out = self.word()
        while len(out) < least:
            out += by + self.word()
        return out

    def made_up(self, least: int) -> str:
        """A long word of syllables, as names and foreign words have."""
        out = ""
        while len(out) < least:
            out += self.pick("bcdfghlmnprstvw") + self.pick("aeiou") + self.pick(["", "", "n", "r", "s", "t"])
        return out

    def assigned(self, value: str) -> str:
        quote = self.pick(['"', "'", ""])
        return self.pick([" = ", "=", ": ", " : "]) + quote + value + quote


NAMED = ["token", "api_key", "secret", "access_token", "auth", "client_secret", "private_key", "API_KEY", "apikey", "credential"]
PASSWORD = ["password", "passwd", "pwd", "db_password", "PASSWORD"]


def _named(make: Callable[[Draw], str], names: list[str] = NAMED):
    def line(d: Draw) -> tuple[str, list[str]]:
        value = make(d)
        return f"{d.word()} {d.pick(names)}{d.assigned(value)} {d.word()}", [value]

    return line


def _short_password(d: Draw) -> str:
    return d.text(3, LETTERS) + d.text(2, LETTERS.upper()) + d.text(2 + d.number(3), "0123456789") + d.text(1 + d.number(5))


def _dotted(d: Draw) -> tuple[str, list[str]]:
    parts = ["eyJ" + d.text(17 + d.number(16)), "eyJ" + d.text(24 + d.number(30)), d.text(30 + d.number(13), ALNUM + "_-")]
    return f"{d.pick(['Authorization: Bearer', 'bearer token', 'auth token:', 'jwt token ='])} {'.'.join(parts)}", parts


def _prefixed(d: Draw) -> tuple[str, list[str]]:
    value = d.pick(["ghp_", "sk_live_", "xoxb-", "pat_", "glpat-", "npm_"]) + d.text(24 + d.number(13))
    return f"{d.word()} {d.word()} {value} {d.word()}", [value]


def _in_url(d: Draw) -> tuple[str, list[str]]:
    value = d.text(16 + d.number(12))
    return f"https://{d.word()}:{value}@{d.word()}.example.org/{d.word()} password", [value]


def _in_json(d: Draw) -> tuple[str, list[str]]:
    value, name = d.text(24 + d.number(17)), d.pick(["secret", "token", "api_key", "secret_access_key", "authorization_token"])
    return f'{{"{name}":"{value}","{d.word()}":{d.number(1000)},"ok":true}}', [value]


def _plain(make: Callable[[Draw], str]):
    def line(d: Draw) -> tuple[str, list[str]]:
        return f"{d.word()} {make(d)} {d.word()} {d.word()}", []

    return line


# Form -> (line, its secrets).
FORMS: dict[str, Callable[[Draw], tuple[str, list[str]]]] = {
    "hex_40": _named(lambda d: d.hex(40)),
    "hex_32": _named(lambda d: d.hex(32)),
    "hex_64": _named(lambda d: d.hex(64)),
    "encoded_40": _named(lambda d: d.encoded(40), ["aws_secret_access_key", *NAMED]),
    "encoded_88": _named(lambda d: d.encoded(86) + "=="),
    "access_key_id": _named(lambda d: "AKIA" + d.text(16, LETTERS.upper() + "234567"), ["access_key_id", "aws_access_key_id", "key", "access key"]),
    "letters_only": _named(lambda d: d.text(16 + d.number(16), LETTERS + LETTERS.upper()), PASSWORD + NAMED),
    "api_key_16_to_31": _named(lambda d: d.text(16 + d.number(16)), ["key", "api key", *NAMED]),
    "short_password": _named(_short_password, PASSWORD),
    "dotted_token": _dotted,
    "prefixed_token": _prefixed,
    "in_url": _in_url,
    "in_json": _in_json,
    "no_made_up_word": _plain(lambda d: d.made_up(16 + d.number(14))),
    "no_joined_words": _plain(lambda d: d.joined(16 + d.number(20))),
    "no_identifier": _plain(lambda d: d.joined(16 + d.number(14), "_") + d.pick(["", "()", ";", " ="])),
    "no_slug": _plain(lambda d: d.joined(16 + d.number(24), "-")),
    "no_camel_case": _plain(lambda d: d.word() + "".join(d.word().capitalize() for _ in range(3 + d.number(3))) + "Service"),
    "no_path": _plain(lambda d: "/" + d.joined(18 + d.number(30), "/") + d.pick(["", ".txt", ".html"])),
    "no_address": _plain(lambda d: f"https://{d.word()}.example.org/{d.joined(16 + d.number(30), d.pick('-/_'))}"),
    "no_number": _plain(lambda d: d.text(16 + d.number(5), "0123456789")),
    "no_date": _plain(lambda d: f"20{10 + d.number(20)}-0{1 + d.number(9)}-{10 + d.number(18)}T{10 + d.number(14)}-{10 + d.number(50)}"),
    "no_uuid": _plain(lambda d: d.pick(["id ", "request ", "id: "]) + "-".join(d.hex(n) for n in (8, 4, 4, 4, 12))),
    "no_line": _plain(lambda d: d.pick("=-_ab+") * (16 + d.number(40))),
    "no_checksum": _plain(lambda d: d.pick(["commit ", "sha256: ", "etag ", "checksum "]) + d.hex(d.pick([32, 40, 64]))),
    "no_field_name": lambda d: (f'{{"{d.pick(["secret_access_key", "authorization_header", "private_key_path", "api_token_expires", "password_hash_rounds"])}":{d.number(100)}}}', []),
    "no_text_behind_name": lambda d: (f"{d.pick(PASSWORD + NAMED)}: {d.pick(['required', 'optional', 'forgotten', 'unavailable', d.made_up(9), d.joined(9)])} {d.word()}", []),
    "no_word_in_sentence": lambda d: (f"the {d.pick(['key', 'secret', 'token', 'private'])} {d.made_up(16 + d.number(8))} {d.word()}", []),
}


def labelled_lines(words: list[str], per_form: int = PER_FORM) -> list[tuple[int, str, str, list[str]]]:
    """(doc_id, form, line, its secrets); ``words`` are the corpus's own frequent words (two at least)."""
    words = [w for w in words if w.isascii() and w.isalpha()] or ["some", "words"]
    out = []
    for n, (form, line) in enumerate(FORMS.items()):
        for i in range(per_form):
            text, found = line(Draw(form, i, words))
            out.append((n * per_form + i, form, text, found))
    return out
