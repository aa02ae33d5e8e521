"""Credentials embedded in code, configuration, snippets and locations: found by entropy, redacted in place.

Quoted strings and long tokens are extracted from each line; the Shannon entropy of a value, over the alphabet it is
written in, is held against what random text of its length would have. Hashes, identifiers, placeholders and
references are excluded. A name or phrase that announces a credential lowers the demand, because passwords people choose
are less random than keys; without one only long random tokens count.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = "***REDACTED***"
#: share of a random string's entropy that an unannounced, an announced value must reach
STRICT, LENIENT = 0.86, 0.66
#: least length of an unannounced, an announced value
STRICT_LENGTH, LENIENT_LENGTH = 20, 8

# fixed values: names and phrases that announce a credential, in several languages
_ANNOUNCE = (
    r"pass(?:word|wd|phrase|code)?s?|pwd|pw|secret|token|api[-_. ]?key|access[-_. ]?key|auth(?:orization|entication)?|credentials?|private[-_. ]?key|"
    r"signing[-_. ]?key|encryption[-_. ]?key|client[-_. ]?key|license[-_. ]?key|account[-_. ]?key|bearer|jwt|session|cookie|identified by|login|"
    r"passwort|kennwort|contraseña|clave|mot[-_ ]de[-_ ]passe|senha|hasło|пароль|wachtwoord|parola|şifre|密码|パスワード"
)
# fixed values: names whose values are public, whatever they look like
_HARMLESS = (
    r"sha-?\d*|md5|hash|digest|checksum|integrity|etag|commit|revision|rev|request[-_]?id|trace[-_]?id|span[-_]?id|uuid|guid|[a-z]*count|label|name|title|"
    r"version|url|uri|path|file|dir|public[-_ ]?key|fingerprint|certificate|cert|subject|issuer|serial|locale|format|type|field|header|length|size|ttl|expiry|timeout"
)
# fixed values: stems of values that stand for a credential without being one
_PLACEHOLDER = (
    r"example|changeme|change[-_]me|placeholder|redacted|removed|masked|hidden|dummy|sample|your[-_]|my[-_]?(?:secret|token|password|key)|insert|replace|todo|fixme|"
    r"none|null|undefined|xxxx|\*\*\*|\.\.\.\.|0000000000|1234567890|abcdef|not[-_]?(?:a|the|real)|fake"
)
# fixed values: prefixes by which issuers mark their keys
_ISSUED = re.compile(
    r"(?:AKIA|ASIA)[0-9A-Z]{12,}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}|[sr]k_(?:live|test)_[A-Za-z0-9]{12,}|xox[abeprs]-[A-Za-z0-9-]{6,}|"
    r"npm_[A-Za-z0-9]{10,}|AIza[\w-]{30,}|eyJ[\w-]{8,}\.[\w-]{8,}(?:\.[\w-]*)?|SG\.[\w-]{16,}\.[\w-]{16,}|pypi-[\w-]{20,}|dop_v1_[0-9a-f]{20,}"
)
_UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
_DIGEST = re.compile(r"(?:sha\d+|md5)[-:]", re.I)
_ANNOUNCED = re.compile(rf"(?:(?<![a-z])(?:{_ANNOUNCE})|password|passwd|passphrase|pwd|secret|token|api[-_. ]?key)(?![a-z])", re.I)
_HARMLESS_NAME = re.compile(rf"(?:^|[-_. ])(?:{_HARMLESS})s?$", re.I)
_HARMLESS_END = re.compile(rf"(?:{_HARMLESS})$", re.I)
_STANDS_FOR = re.compile(_PLACEHOLDER, re.I)
_REFERENCE = re.compile(r"^\$\{?\w+\}?$|\$\{|\{\{|\$\(|^%\w+%$|^<.*>$|^\[.*\]$|process\.env|environ|getenv|^env[:.]|secretRef|valueFrom|^@\w+$|^ref\+|://[^@]*$")
_HOST = re.compile(r"[a-z0-9-]+(?:\.[a-z0-9-]+)+(?::\d+)?(?:/.*)?")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_KEY_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]+?)-----")
_BODY = re.compile(r"^\s*(?://|#|--|\*|;)?\s*[A-Za-z0-9+/=\\n]{8,}[\"'`;,)]*\s*$")
_VOWEL = re.compile(r"[aeiouyAEIOUYäöüéèêáíóúàâôû]")
_NO_VOWELS = re.compile(r"[^aeiouyAEIOUYäöüéèêáíóúàâôû]{5}")
_WORDS = re.compile(r"[^\W\d_]+")
#: what is left of an ASCII value's words when names are taken apart
_PIECES = re.compile(r"[A-Z]+[a-z]*|[a-z]+")
_SMALL, _LARGE, _SIGN = re.compile(r"[a-z]"), re.compile(r"[A-Z]"), re.compile(r"[^A-Za-z0-9]")
_LETTER, _BLANK, _BRACKET = re.compile(r"[A-Za-z]"), re.compile(r"\s"), re.compile(r"[()\[\]{}]")
_ALPHABETS = [(16, re.compile(r"[0-9a-f-]+|[0-9A-F-]+")), (36, re.compile(r"[0-9a-z_-]+|[0-9A-Z_-]+")), (64, re.compile(r"[A-Za-z0-9+/=_.-]+"))]
_FIGURES = re.compile(r"[\d.,:%_-]+")
_HEX = re.compile(r"(?:0x)?[0-9a-fA-F]+")
_DOTTED = re.compile(r"[A-Za-z_][\w]*(?:\.[A-Za-z_]\w*)+")
_IDENTIFIER = re.compile(r"[a-z]+(?:[_/.-][a-z]+)*[_-]?\d{0,3}|[A-Z]+(?:_[A-Z]+)*_?\d{0,3}|(?:[a-z]+)(?:[A-Z][a-z]+)*\d{0,3}")
_FILE_END = re.compile(r"\.(?:\w{1,5})$")

#: places a value can stand in, tried in this order; group v is the value, group n (where there is one) its name
_PLACES = [
    re.compile(r"(?<![\w+.-])[a-z][\w+.-]*://[^\s/:@'\"]*:(?P<v>[^\s/'\"]+?)@(?=[\w.-]+)", re.I),
    re.compile(r"(?:^|\s)-u\s+['\"]?[\w.@-]+:(?P<v>[^\s'\"]+)"),
    re.compile(r"\b(?P<n>sshpass\s+-p|identified\s+by|with\s+password|password\s+is|passphrase\s+is|pass\s+is|token\s+is|login\s+\S+\s+password|bearer|basic)\s+(?P<q>['\"]?)(?P<v>[^\s'\"`;,)<>]+)", re.I),
    re.compile(r"<(?P<n>[\w.:-]+)>(?P<v>[^<>\s]+)</"),
    re.compile(r"key\s*=\s*[\"'](?P<n>[^\"']+)[\"']\s+value\s*=\s*[\"'](?P<v>[^\"']+)[\"']", re.I),
    re.compile(r"\b(?P<n>login|authenticate|sign_?in|log_?in)\s*\(\s*['\"][^'\"]*['\"]\s*,\s*(?P<q>['\"])(?P<v>(?:(?!(?P=q)).)+)(?P=q)", re.I),
    re.compile(r"[\"'](?P<n>[\w.-]+)[\"']\s*[,:]\s*(?P<q>[\"'])(?P<v>(?:(?!(?P=q)).)+)(?P=q)"),
    re.compile(r"(?<![\w.-])-{0,2}(?P<n>\w[\w.-]*)\s*(?::=|=>|[:=])\s*\(?\s*(?P<q>[\"'`])(?P<v>(?:(?!(?P=q)).)+)(?P=q)"),
    re.compile(r"(?<![\w.-])-{0,2}(?P<n>\w[\w.-]*)\s*(?:=|:\s)\s*(?P<v>[^\s\"'`;,&|()<>\[\]{}]+)"),
    re.compile(r"^\s*(?:ENV|ARG)\s+(?P<n>\w+)\s+(?P<v>\S+)"),
    re.compile(r"(?P<q>[\"'`])(?P<v>(?:(?!(?P=q)).){6,}?)(?P=q)"),
    re.compile(r"(?<![\w+/=.$-])(?P<v>[A-Za-z0-9+/_-][A-Za-z0-9+/_.-]{14,}={0,2})(?![\w+/-])"),
]
# fixed values: stems in lower case, and the beginnings of issuers' keys, without one of which only a long run can be a credential
_STEMS = (
    "pass", "pwd", "secret", "token", "key", "auth", "cred", "bearer", "basic", "jwt", "session", "cookie", "identified", "login", "log_in", "sign", "kennwort", "contrase",
    "clave", "mot de", "mot_de", "mot-de", "senha", "hasło", "пароль", "wacht", "parola", "şifre", "密码", "パスワード", "-----", "://", "pw"
)
_ISSUERS = (
    "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "sk_live_", "sk_test_", "rk_live_", "rk_test_",
    "xoxa-", "xoxb-", "xoxe-", "xoxp-", "xoxr-", "xoxs-", "npm_", "AIza", "eyJ", "SG.", "pypi-", "dop_v1_"
)
#: what a value that nothing announces must lie in: a run with a digit, bare or after a quote or a tag
_LONG = re.compile(r"(?<![^\s\"'`;,&|()<>\[\]{}])[^\s\"'`;,&|()<>\[\]{}]{%d,}|[\"'`>]\S{%d,}" % (STRICT_LENGTH, STRICT_LENGTH))
_QUOTE_FIRST = re.compile(r"\s*(?:[+.]\s*)?[\"']")
#: a line of a text, not its first, that begins so
_QUOTE_LATER = re.compile(r"\n[^\S\n]*(?:[+.][^\S\n]*)?[\"']")
#: letters that a pattern takes for others when case is ignored, though they have another small letter
_FOLDED = str.maketrans({"İ": "i", "ı": "i", "ſ": "s", "ᲂ": "о"})
_DIGIT = re.compile(r"\d")


def shannon(value: str) -> float:
    """Bits a character of ``value`` carries under its own frequencies."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def alphabet_size(value: str) -> int:
    """Characters of the smallest usual alphabet that ``value`` is written in: digits, hex, letters and digits, base64, printable."""
    if value.isdigit():
        return 10
    return next((n for n, signs in _ALPHABETS if signs.fullmatch(value)), 94)


def randomness(value: str) -> float:
    """Entropy as a share of what random text of this length in this alphabet has on average."""
    n, a = len(value), alphabet_size(value)
    # expected entropy of n draws from a characters: log2(n) while few repeat, log2(a) less a bias when many do
    expected = min(math.log2(n) - (n - 1) / (2 * a * math.log(2)) if n < a else 99, math.log2(a) - (a - 1) / (2 * n * math.log(2)) if n >= a else 99)
    return shannon(value) / expected if expected > 0 else 0.0


@lru_cache(maxsize=1 << 16)
def _word_length(piece: str) -> int:
    """Letters of a piece in one case pattern with a vowel and without a run of five other letters, 0 if it is none."""
    whole = len(piece) >= 3 and (piece.islower() or piece.isupper() or piece.istitle()) and _VOWEL.search(piece) and not _NO_VOWELS.search(piece)
    return len(piece) if whole else 0


def wordlike(value: str) -> float:
    """Share of the letters and digits that stand in whole words: pieces of three letters or more in one case pattern, with a vowel."""
    letters = sum(map(str.isalnum, value))
    if not letters:
        return 1.0
    pieces = _PIECES.findall(value) if value.isascii() else [w for part in _WORDS.findall(value) for w in _CAMEL.split(part)]
    return sum(map(_word_length, pieces)) / letters


def _classes(value: str) -> int:
    return sum(bool(p.search(value)) for p in (_SMALL, _LARGE, _DIGIT, _SIGN))


def _random_enough(value: str, announced: bool) -> bool:
    """Whether a value looks like a credential; what rules out most values for little comes first."""
    digit = _DIGIT.search(value)
    if not announced:
        if len(value) < STRICT_LENGTH or not digit or (words := wordlike(value)) > 0.45 or not _LETTER.search(value):
            return False
        if _HEX.fullmatch(value):
            return False  # a hash
        if words > 0.3 and (value.count("/") > 1 or _FILE_END.search(value)):
            return False  # a path or a file
        return randomness(value) >= STRICT
    if not digit:
        # no digit: a random mix of cases in a long string, else a word, a path or a label
        return len(value) >= 12 and wordlike(value) < 0.6 and _classes(value) >= 3 and randomness(value) >= LENIENT
    words = wordlike(value)
    if words > 0.6 and (_IDENTIFIER.fullmatch(value) or _DOTTED.fullmatch(value) and not _ISSUED.match(value)):
        return False  # an identifier or a dotted reference
    classes = _classes(value)
    if classes < 2 or classes == 2 and (len(value) < 12 or words >= 0.7):
        return False
    return not _FIGURES.fullmatch(value) and not _BRACKET.search(value) and randomness(value) >= LENIENT


@lru_cache(maxsize=1 << 16)
def is_credential(value: str, announced: bool, password_place: bool = False) -> bool:
    """Whether a value, in a place that announces a credential or not, is one."""
    announced = announced or password_place
    if len(value) < (LENIENT_LENGTH if announced else STRICT_LENGTH - 5):
        return False
    if not _random_enough(value, announced) and not _ISSUED.fullmatch(value):
        return False
    # few values come this far: only they are held against what stands for a credential without being one
    if _BLANK.search(value) or value.startswith("//") or _HOST.fullmatch(value):
        return False
    return not (_REFERENCE.search(value) or _STANDS_FOR.search(value) or _UUID.fullmatch(value) or _DIGEST.match(value))


@lru_cache(maxsize=16)
def _announcements(line: str) -> tuple[list[int], int | None, int | None]:
    """Where names are taken apart, the end of the first word that announces a credential and the start of the last, in the line taken apart."""
    spots = [m.span() for m in _ANNOUNCED.finditer(_CAMEL.sub(" ", line).replace("_", " "))]
    return [m.start() for m in _CAMEL.finditer(line)], spots[0][1] if spots else None, spots[-1][0] if spots else None


def _back(line: str, at: int, signs: str, most: int | None = None) -> int:
    """The place before blanks, and the given signs (no more than ``most``), that end at a place."""
    while at and line[at - 1].isspace():
        at -= 1
    while at and line[at - 1] in signs and most != 0:
        at, most = at - 1, most and most - 1
    return at


def _name_before(line: str, at: int, signs: str) -> str | None:
    """The name before an assignment that ends at a place."""
    end = _back(line, at, signs)
    if end == _back(line, at, ""):
        return None
    start = end = _back(line, end, "")
    while start and (line[start - 1].isalnum() or line[start - 1] in "_.-"):
        start -= 1
    return line[start:end].lstrip(".-") or None


#: characters that the longest harmless name has at most
_NAME_BOUND = 40


def _announced(line: str, at: int, end: int, name: str | None) -> bool | None:
    """True if name or line, whatever its length, announce a credential, None if the value's own name says it is harmless."""
    if name:
        spelt = _CAMEL.sub("_", name)
        if _HARMLESS_NAME.search(spelt):
            return None
        if _ANNOUNCED.search(spelt.replace("_", " ")):
            return True
    before = _back(line, _back(line, _back(line, at, "\"'`", 1), ":=("), "")
    if _HARMLESS_END.search(_CAMEL.sub(" ", line[max(0, before - _NAME_BOUND) : before]).replace("_", " ")):
        return None
    cuts, first, last = _announcements(line)
    return first is not None and (first <= at + bisect_left(cuts, at) or last >= end + bisect_right(cuts, end))


def _body_span(line: str) -> tuple[int, int]:
    """The characters of a key's body line: what follows blanks and a comment sign."""
    text = re.match(r"\s*(?://+|#+|--|\*|;)?\s*([A-Za-z0-9+/=\\]*)", line)
    return text.span(1)


_JOINED = re.compile(r"[\"']\s*\+\s*[\"']")
_OPEN_STRING = re.compile(r"[(+\\,.]?\s*(?P<q>[\"'])(?P<v>[^\"']{8,})(?P=q)\s*[+\\.]?\s*$")
_ONLY_STRING = re.compile(r"^\s*[+.]?\s*(?P<q>[\"'])(?P<v>[^\"']{4,})(?P=q)\s*[)+\;,.]*\s*$")


def _open_places(line: str, plain: bool) -> Iterator[int]:
    """The places of which a line has the signs; in a plain one those whose values nothing needs to announce."""
    quoted = "\"" in line or "'" in line
    marked = quoted or "`" in line
    given = "=" in line or ":" in line
    if not plain:
        if "://" in line:
            yield 0
        if "-u" in line:
            yield 1
        yield 2
    if "</" in line:
        yield 3
    if quoted and not plain:
        yield 4
        yield 5
    if quoted:
        yield 6
    if given and marked:
        yield 7
    if given:
        yield 8
    if "ENV" in line or "ARG" in line:
        yield 9
    if marked:
        yield 10
    yield 11


def line_spans(line: str, plain: bool = False) -> list[tuple[int, int]]:
    """(start, end) of the credentials of one line; ``plain``: it is known to hold no stem and no issuer's beginning, so that nothing in it is announced."""
    spans: list[tuple[int, int]] = []  # in order, none over another

    def taken(a: int, b: int) -> bool:
        before = bisect_left(spans, (b,))
        return before > 0 and spans[before - 1][1] > a

    def add(a: int, b: int) -> None:
        if not taken(a, b):
            insort(spans, (a, b))

    for m in () if plain else _ISSUED.finditer(line):
        if (m.start() == 0 or not re.match(r"[A-Za-z0-9]", line[m.start() - 1])) and not _STANDS_FOR.search(m.group()):
            end = m.end()
            add(m.start(), end)
    # a value cut into strings joined on one line: judged as a whole, spans of the parts
    if _JOINED.search(line):
        parts = list(re.finditer(r"(?P<q>[\"'])(?P<v>[^\"']+)(?P=q)", line))
        whole = "".join(p["v"] for p in parts)
        if len(parts) > 1 and re.fullmatch(r"[\"'](?:[^\"']*[\"']\s*\+\s*[\"'])+[^\"']*[\"']", line[parts[0].start() : parts[-1].end()]):
            said = _announced(line, parts[0].start(), parts[-1].end(), _name_before(line, parts[0].start(), ":=("))
            if said is not None and is_credential(whole, said):
                spans.clear()
                for p in parts:
                    add(p.start("v"), p.end("v"))
                return spans
    least = STRICT_LENGTH if plain else 1
    for k in _open_places(line, plain):
        for m in _PLACES[k].finditer(line):
            a, b = m.span("v")
            if b - a < least:
                continue
            value = m["v"]
            while value and value[-1] in ",;\\":
                value, b = value[:-1], b - 1
            if not value or taken(a, b):
                continue
            if k < 3 or k == 5:
                ok = is_credential(value, True, True)
            else:
                # what surrounds it is read only where it can decide
                if len(value) < LENIENT_LENGTH or not (is_credential(value, False) or not plain and is_credential(value, True)):
                    continue
                said = _announced(line, a, b, m.groupdict().get("n"))
                ok = said is not None and is_credential(value, said)
            if ok:
                add(a, b)
    return spans


@lru_cache(maxsize=1)
def _stems():
    import ahocorasick

    found = ahocorasick.Automaton()
    for stem in (*_STEMS, "-u"):
        found.add_word(stem, stem)
    for prefix in _ISSUERS:
        found.add_word(prefix.lower(), prefix)
    found.make_automaton()
    return found


def _counts(text: str, end: int, stem: str) -> bool:
    """Whether a stem that ends here is one: issuers' beginnings in their own spelling, -u as a word."""
    if stem == "-u":
        return (end < 2 or text[end - 2].isspace()) and text[end + 1 : end + 2].isspace()
    return stem not in _ISSUERS or text.startswith(stem, end + 1 - len(stem))


def worth_reading(lines: list[str | None]) -> tuple[set[int], set[int]]:
    """Numbers (0-based) of all lines that can hold a credential, by themselves or with the next, and of those with a stem: a few passes over the whole text."""
    text = "\n".join(x or "" for x in lines)
    low = (text if text.isascii() else text.translate(_FOLDED)).lower()
    starts = list(accumulate((len(x or "") + 1 for x in lines), initial=0))
    stems = {bisect_right(starts, end) - 1 for end, stem in _stems().iter(low) if _counts(text, end, stem)}
    worth = stems | {bisect_right(starts, m.start()) - 1 for m in _LONG.finditer(text) if _DIGIT.search(m[0])}
    # single lines are looked at where the text has what is sought in them
    joined, named, later = _JOINED.search(text), "ENV" in text or "ARG" in text, _QUOTE_LATER.search(text)
    for i, line in enumerate(lines) if joined or named or later else ():
        if not line:
            continue
        if joined and "+" in line and _JOINED.search(line) or named and line.lstrip().startswith(("ENV", "ARG")):
            worth.add(i)
        if later and i and i - 1 not in worth and lines[i - 1] and _QUOTE_FIRST.match(line) and _ONLY_STRING.match(line) and _OPEN_STRING.search(lines[i - 1]):
            worth.add(i - 1)
    return worth, stems


def text_spans(lines: list[str | None]) -> dict[int, list[tuple[int, int]]]:
    """Credential spans of each line (0-based) of one text, private keys and values over several lines included."""
    out: dict[int, list[tuple[int, int]]] = {}
    worth, stems = worth_reading(lines)
    block: str | None = None
    started = 0
    for i in range(len(lines)) if any("-----" in lines[i] for i in worth) else sorted(worth):
        line = lines[i]
        if not line or (block is None and i not in worth):
            continue
        marks = list(_KEY_MARK.finditer(line)) if "-----" in line else []
        if marks:
            for k, mark in enumerate(marks):
                private = "PRIVATE KEY" in mark[2]
                if mark[1] == "BEGIN":
                    block, started = ("private" if private else "public"), i
                    if private:
                        end = marks[k + 1].start() if k + 1 < len(marks) else len(line)
                        out[i] = out.get(i, []) + ([(mark.end(), end)] if len(line[mark.end() : end].strip()) > 4 else [])
                else:
                    if block is None and private:
                        # the text begins inside a key: its body is what stands above
                        j = i - 1
                        while j >= 0 and lines[j] and _BODY.match(lines[j]):
                            out[j] = [_body_span(lines[j])]
                            j -= 1
                    if private:
                        out.setdefault(i, [])
                    block = None
            continue
        if block and (_BODY.match(line) or re.match(r"^\s*(?://|#)?\s*(?:Proc-Type|DEK-Info|Comment|Version)\s*:", line)):
            if block == "private":
                out[i] = [_body_span(line)]
            continue
        if block and i > started and line.strip(" /#*;"):
            block = None  # ordinary text again: the block was never closed
        spans = line_spans(line, i not in stems)
        if spans:
            out[i] = spans
        # a value that goes on as a string alone on the next lines
        first = _OPEN_STRING.search(line) if i + 1 < len(lines) and lines[i + 1] and _QUOTE_FIRST.match(lines[i + 1]) else None
        if first:
            parts, j = [], i + 1
            while j < len(lines) and lines[j] and (m := _ONLY_STRING.match(lines[j])):
                parts.append((j, m.span("v"), m["v"]))
                closed = not lines[j].rstrip().endswith(("+", "\\", '"', "'"))
                j += 1
                if closed:
                    break
            if parts:
                said = _announced(line, first.start("v"), first.end("v"), _name_before(line, _back(line, first.start("q"), "(", 1), ":="))
                if said is not None and is_credential(first["v"] + "".join(p[2] for p in parts), said):
                    out[i] = sorted({*out.get(i, []), first.span("v")})
                    for j, span, _ in parts:
                        out[j] = [span]
    return out


def redacted(line: str, spans: list[tuple[int, int]]) -> str:
    """The line with each span replaced, the code around it as it was."""
    for a, b in reversed(spans):
        line = line[:a] + MASK + line[b:]
    return line


_NUMBERED = re.compile(r"^\d+: ?")


def _judge(origin: str, lines: list[str | None]) -> tuple[list[int], list[str | None]]:
    """1-based numbers of the lines with credentials, and the redacted lines."""
    if origin == "location":  # each is a text of its own
        found = {i: s for i, x in enumerate(lines) if x and (s := line_spans(x))}
        cut = [0] * len(lines)
    else:
        cut = [len(m[0]) if origin == "finding" and x and (m := _NUMBERED.match(x)) else 0 for x in lines]
        found = text_spans([x[c:] if x else x for x, c in zip(lines, cut)])
    clean = [x if i not in found else x[: cut[i]] + redacted(x[cut[i] :], found[i]) for i, x in enumerate(lines)]
    return sorted(i + 1 for i in found), clean


def credential_texts(texts: DataFrame) -> DataFrame:
    """origin, record_no, line_nos, redacted of each text with credentials; ``texts`` has origin, record_no, lines.

    Null lines and null or empty texts hold nothing. Lines of any length are read whole.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            origins, numbers, lines = (c.to_pylist() for c in batch.columns)
            kept = [(o, n, *_judge(o, x)) for o, n, x in zip(origins, numbers, lines) if x]
            kept = [r for r in kept if r[2]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in kept], pa.string()), pa.array([r[1] for r in kept], pa.int64()), pa.array([r[2] for r in kept], pa.list_(pa.int32())), pa.array([r[3] for r in kept], pa.list_(pa.string()))],
                names=["origin", "record_no", "line_nos", "redacted"],
            )

    return texts.select("origin", "record_no", "lines").mapInArrow(judge, "origin string, record_no bigint, line_nos array<int>, redacted array<string>")


def _texts(origin: str, number: str, lines: Column, table: DataFrame) -> DataFrame:
    return table.select(F.lit(origin).alias("origin"), F.col(number).cast("long").alias("record_no"), lines.alias("lines")).where("record_no is not null and size(lines) > 0")


def all_texts(source_files: DataFrame, scan_findings: DataFrame) -> DataFrame:
    """The texts credentials are sought in: lines of files, snippets of findings, locations of findings."""
    return (
        _texts("file", "file_no", F.col("lines"), source_files)
        .unionByName(_texts("finding", "finding_no", F.split("code_snippet", "\n"), scan_findings))
        .unionByName(_texts("location", "finding_no", F.col("secret_related_locations"), scan_findings))
    )


def credential_lines(source_files: DataFrame, scan_findings: DataFrame) -> DataFrame:
    """origin, record_no, line_no of each line that holds a credential or a piece of one; repeated rows count once."""
    found = credential_texts(all_texts(source_files, scan_findings))
    return found.select("origin", "record_no", F.explode("line_nos").alias("line_no")).distinct()


def redacted_texts(source_files: DataFrame, scan_findings: DataFrame) -> DataFrame:
    """origin, record_no, redacted: every text with a credential, each credential replaced and all else unchanged."""
    return credential_texts(all_texts(source_files, scan_findings)).select("origin", "record_no", "redacted").distinct()
