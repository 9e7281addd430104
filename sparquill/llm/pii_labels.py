"""The small labelled table that the PII tagger learns from, written by a seeded generator.

Each row is a list of tokens and a tag for each: O, or B-/I- before EMAIL, PHONE, IP, CARD and SECRET. Half of the
rows hold none, but numbers, dates, prices, versions and the like that have to be left alone, among them numbers as
long as a card's whose check digit doesn't hold.
"""

from __future__ import annotations

import random

KINDS = ("EMAIL", "PHONE", "IP", "CARD", "SECRET")
SEED, ROWS = 20240501, 900

_PLAIN = "the of and a plain word Another sentence, with some. Words; that say nothing! about anyone? für éàü niño CAPS | ### || &&& $$$ tea - (and so on) \"quoted\" don't".split()
_TLD = ("com", "org", "net", "example.com", "co.uk", "de")


def _word(r: random.Random) -> str:
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyzéüñ") for _ in range(r.randint(1, 9)))


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _email(r: random.Random) -> list[str]:
    user = r.choice([f"{_word(r)}.{_digits(r, r.randint(1, 3))}", f"{_word(r)}.{_word(r)}", _word(r), f"{_word(r)}_{_word(r)}{_digits(r, 2)}", f"{_word(r)}+{_word(r)}"])
    host = r.choice([f"mail{r.randint(0, 9)}.{r.choice(_TLD)}", f"{_word(r)}.{r.choice(_TLD)}", f"{_word(r)}-{_word(r)}.{r.choice(_TLD)}"])
    return [f"{user}@{host}"]


def _phone(r: random.Random) -> list[str]:
    a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
    return r.choice([[f"+{r.randint(1, 99)}", f"({a})", f"{b}-{c}"], [f"+1", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"+{r.randint(1, 99)}", a, b, c], [f"+1-{a}-{b}-{c}"]])


def _ip(r: random.Random) -> list[str]:
    return [".".join(str(r.randint(0, 255)) for _ in range(4))]


def luhn(number: str) -> bool:
    """Whether the last digit is the check digit that card numbers have."""
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) << (i & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _number(r: random.Random, n: int, valid: bool) -> str:
    """n digits with a check digit that holds, or doesn't."""
    head = _digits(r, n - 1)
    return head + r.choice([d for d in "0123456789" if luhn(head + d) == valid])


def _card(r: random.Random) -> list[str]:
    n = _number(r, 16, True)
    return r.choice([[n], [n], [n], [n[:4], n[4:8], n[8:12], n[12:]], ["-".join((n[:4], n[4:8], n[8:12], n[12:]))], [_number(r, 15, True)]])


def _secret(r: random.Random) -> list[str]:
    n = r.choice([32, 40, 40, 40, 40, 64])
    s = "".join(r.choice("0123456789abcdef") for _ in range(n))
    if r.random() < 0.3:
        letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        s = r.choice(["", "", "sk_", "key-", "ghp_"]) + "".join(r.choice(letters) for _ in range(r.choice([20, 24, 32, 36, 44])))
        if r.random() < 0.4:  # key names in capitals
            s = r.choice(["AKIA", "ASIA", "KEY", ""]) + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    if r.random() < 0.15:  # with its name in the same token
        return [r.choice(["password=", "token=", "key=", "secret:"]) + s[: r.choice([16, 18, 20, 40])]]
    return [r.choice([f'"{s}"', f'"{s}"', s, f"'{s}'", f'"{s}"'])]


def _harmless(r: random.Random) -> list[str]:
    return r.choice([
        [_digits(r, r.randint(1, 4))], [f"{r.randint(1, 9)}.{r.randint(0, 9)}"], [f"{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 20)}"], [f"${_digits(r, 2)}.{_digits(r, 2)}"], [f"{r.randint(1, 23)}:{_digits(r, 2)}"],
        [f"20{_digits(r, 2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}"], [f"{_digits(r, 1)},{_digits(r, 3)},{_digits(r, 3)}"], [f"{r.randint(1, 99)}%"], ["version", f"{r.randint(1, 4)}.0"], ["x", "=", str(r.randint(1, 99))],
        ["(c)", f"20{_digits(r, 2)}"], [f"{_digits(r, 5)}"], [f"#{_digits(r, 3)}"], [f"{_digits(r, 6)}"], ["No.", _digits(r, 2)], [f"[{r.randint(1, 40)}]"], [f"{r.randint(1, 9)}th"], ["=", f'"{_word(r)}"'], ["BY-NC", "4.0"], [f"v{r.randint(1, 9)}"], [f"@{_word(r)}"], ["a", "+", "b"], [f"{r.randint(1, 9)}-{r.randint(10, 20)}"], [f"{_word(r)}_{_word(r)}_{_word(r)}_{_word(r)}"], [f"{_word(r)}({_word(r)}_{_digits(r, 1)})"], [f"https://{_word(r)}.com/{_word(r)}/{_digits(r, 4)}"], [_number(r, r.choice([15, 16, 16]), False)], [_number(r, 16, False)],
    ])


def _clothed(r: random.Random, tokens: list[str]) -> list[str]:
    """Punctuation as it may stand around the first and the last token."""
    tokens = list(tokens)
    if r.random() < 0.35:
        tokens[-1] += r.choice([".", ",", "!", "?", "!!", "***", "###", "&&&", "$$$", "%%%", ";", ":", ").", "|"])
    if r.random() < 0.08:
        tokens[0] = r.choice(["(", "[", "<", "*"]) + tokens[0]
    return tokens


def labelled_rows(rows: int = ROWS, seed: int = SEED) -> list[tuple[list[str], list[str]]]:
    r = random.Random(seed)
    make = {"EMAIL": _email, "PHONE": _phone, "IP": _ip, "CARD": _card, "SECRET": _secret}
    out = []
    for _ in range(rows):
        tokens: list[str] = []
        tags: list[str] = []

        def plain(n: int, tokens=tokens, tags=tags) -> None:
            for _ in range(n):
                tokens.append(r.choice(_PLAIN) if r.random() < 0.6 else _word(r))
                tags.append("O")

        plain(r.randint(0, 5))
        for _ in range(r.randint(1, 3)):
            if r.random() < 0.5:
                kind = r.choice(KINDS)
                if kind == "SECRET" and r.random() < 0.7:
                    tokens += [r.choice(["token", "key", "secret", "password", "api_key"]), r.choice(["=", ":", "="])]
                    tags += ["O", "O"]
                value = _clothed(r, make[kind](r))
                tags += [("B-" if i == 0 else "I-") + kind for i in range(len(value))]
            else:
                value = _clothed(r, _harmless(r))
                tags += ["O"] * len(value)
            tokens += value
            plain(r.choice([0, 0, 1, 2, 4]))
        out.append((tokens, tags))
    return out
