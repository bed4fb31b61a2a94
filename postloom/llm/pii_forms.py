"""Written forms of personal data that the base patterns miss, and numbers that are none: what the tagger is trained on
besides the base spans. A form is drawn from a random generator, so that a seed gives the same ones each time."""

from __future__ import annotations

import re

import numpy as np

LETTERS = "abcdefghijklmnopqrstuvwxyz"

# ---- fixed values: how people write around the patterns ----
AT = (" (at) ", "(at)", " [at] ", "[at]", " {at} ", " @ ", "(AT)", " (At) ")
DOT = (" (dot) ", "(dot)", " [dot] ", "[dot]", " . ", ".", " {dot} ", " (DOT) ")
ENDINGS = ("org", "com", "net", "edu", "de", "fr", "es", "io", "co.uk")
IP_DOTS = (" . ", "[.]", "(.)", " .", ". ", "{.}", "[dot]")
CARD_GAPS = (".", "  ", "/", " - ", "_")
LEADS = ("", "", "", "tel ", "call ", "mail ", "at ", "id ", "no. ", "card ", "host ", ": ", "(", '"', "<", "- ")
TAILS = ("", "", "", ".", ",", ")", '"', ">", ";", "!", "?")
# ---- end of fixed values ----


def check_digit(digits: str) -> str:
    """The digit that makes a number pass Luhn when it is put behind it."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) << (1 - (k & 1))
        total += v - 9 if v > 9 else v
    return str(-total % 10)


class Forms:
    """Draws written forms: span() those of personal data, other() numbers and words that are none."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def _pick(self, values):
        return values[int(self.r.integers(len(values)))]

    def _word(self, low: int, high: int) -> str:
        return "".join(LETTERS[k] for k in self.r.integers(0, 26, int(self.r.integers(low, high + 1))))

    def _digits(self, n: int) -> str:
        return "".join(str(k) for k in self.r.integers(0, 10, n))

    def email(self) -> str:
        local = self._word(2, 8) + self._pick(("", "", ".", "_", "-"))
        local += self._word(2, 6) if local[-1] in "._-" else self._pick(("", self._digits(2)))
        at, dot = self._pick(AT), self._pick(DOT)
        return local + at + self._word(2, 8) + dot + self._pick(ENDINGS).replace(".", dot)

    def ip(self) -> str:
        return self._pick(IP_DOTS).join(str(int(k)) for k in self.r.integers(0, 256, 4))

    def card(self) -> str:
        if self.r.random() < 0.5:  # 13 digits, plain or in groups
            body = self._pick("345") + self._digits(11)
            body += check_digit(body)
            gap = self._pick(("", "", " ", "-", "."))
            return gap.join((body[:4], body[4:8], body[8:]))
        body = self._pick("3456") + self._digits(14)
        body += check_digit(body)
        return self._pick(CARD_GAPS).join(body[k : k + 4] for k in range(0, 16, 4))

    def phone(self) -> str:
        a, b, c = self._digits(3), self._digits(3), self._digits(4)
        return self._pick((f"({a}) {b}-{c}", f"({a}) {b} {c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b}-{c}", f"001 {a} {b} {c}", f"1-{a}-{b}-{c}", f"0{a[:2]} / {b} {c}{a[0]}", f"00{self._digits(2)} {a} {b}{c}"))

    def span(self) -> tuple[str, str]:
        """(kind, text)."""
        kind = self._pick(("email", "ip", "card", "phone"))
        return kind, getattr(self, kind)()

    def other(self) -> str:
        d = self._digits
        r = self.r.integers
        return self._pick(
            (
                f"{r(1900, 2100)}-{r(1, 13):02d}-{r(1, 29):02d}",
                f"{r(1, 29)}.{r(1, 13)}.{r(1900, 2100)}",
                f"{r(1, 13)}/{r(1, 29)}/{r(1900, 2100)}",
                f"{r(0, 24):02d}:{r(0, 60):02d}:{r(0, 60):02d}",
                f"{r(1, 20)}.{r(0, 20)}",
                f"v{r(1, 20)}.{r(0, 20)}.{r(0, 20)}",
                f"{r(1, 999)},{d(3)}.{d(2)}",
                f"{r(1, 999)} {d(3)} {d(3)}",
                f"{r(1900, 2100)}-{r(1900, 2100)}",
                f"page {r(1, 400)} of {r(1, 400)}",
                f"({r(1, 99)})",
                f"[{r(1, 99)}]",
                d(int(r(1, 10))),
                f"{self._word(1, 3).upper()}-{d(int(r(3, 7)))}",
                f"{d(3)}-{d(2)}",
                f"{r(1, 99)} - {r(1, 99)}",
                f"{r(1, 9)}.{r(1, 9)}.{r(1, 9)}.",
                f"@{self._word(3, 9)}",
                f"{self._word(2, 6)} (at {self._word(3, 7)})",
                f"(attn {self._word(3, 7)})",
                f"0x{d(4)}f{d(3)}",
                "".join(self._pick("0123456789abcdef") for _ in range(32)),
            )
        )

    def written(self, kind: str | None, text: str) -> tuple[str, int, int]:
        """The form among what stands around it: (text, start, end)."""
        lead, tail = self._pick(LEADS), self._pick(TAILS)
        return f"{lead}{text}{tail}", len(lead), len(lead) + len(text)


_AT = re.compile(r"\s*(?:[(\[{]\s*at\s*[)\]}]|@)\s*", re.IGNORECASE)
_DOTS = re.compile(r"\s*(?:[(\[{]\s*(?:dot|\.)\s*[)\]}]|\.)\s*", re.IGNORECASE)


def plain_email(text: str) -> str:
    """An address with its written-out marks as signs."""
    return _DOTS.sub(".", _AT.sub("@", text.strip(), count=1))


def plain_ip(text: str) -> str:
    return _DOTS.sub(".", text.strip())
