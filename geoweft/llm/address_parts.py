"""Reading a written postal address: number, street words, unit and whatever names the town."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from geoweft.llm.confusables import plain_form

# Written forms of street types, directions, unit words and ordinals.
TYPES = {
    "avenue": "av ave aven avenu avenue avn", "boulevard": "blv blvd boul boulevard boulv", "circle": "cir circ circle", "court": "crt ct court", "drive": "dr drive driv drv", "highway": "highway hwy",
    "lane": "la lane ln", "parkway": "parkway parkwy pkway pkwy pky", "place": "pl place plc", "road": "rd road", "square": "sq square", "street": "st str street strt", "terrace": "ter terr terrace", "trail": "trail trl", "way": "way wy",
}
DIRECTIONS = {
    "n": "n no north", "s": "s so south", "e": "e east", "w": "w west", "ne": "ne northeast", "nw": "nw northwest", "se": "se southeast", "sw": "sw southwest",
}
UNIT_WORDS = "apartment apt flat room rm ste suite unit"
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth"

TYPE_OF = {w: t for t, ws in TYPES.items() for w in ws.split()}
DIRECTION_OF = {w: d for d, ws in DIRECTIONS.items() for w in ws.split()}
UNIT_OF = frozenset(UNIT_WORDS.split())
_ENDING = {1: "st", 2: "nd", 3: "rd"}


def ordinal(n: int) -> str:
    return f"{n}{'th' if 10 <= n % 100 <= 20 else _ENDING.get(n % 10, 'th')}"


ORDINAL_OF = {w: ordinal(i + 1) for i, w in enumerate(ORDINALS.split())}


@dataclass
class Parts:
    """One reading of an address. words: street words without direction and type; towns: trailing segments that may name
    the town; postcode: five digits written in the address. cost: how far-fetched the reading is."""

    number: str = ""
    direction: str = ""
    words: list[str] = field(default_factory=list)
    type_: str = ""
    unit: str = ""
    towns: list[str] = field(default_factory=list)
    postcode: str = ""
    cost: float = 0.0


def fold(text: str | None) -> str:
    """Plain characters, lower case, no accents, single spaces."""
    plain = unicodedata.normalize("NFKD", plain_form(text or "").lower())
    return " ".join("".join(c for c in plain if not unicodedata.combining(c)).split())


def postcode5(text: str | None) -> str:
    """Five digits of a written postcode, '' if it can't be repaired: letters O for zeros, a state before it, +4 after it, a
    decimal from a number column, leading zeros lost."""
    s = (text or "").strip().upper()
    if not s:
        return ""
    s = re.sub(r"^[A-Z]{2}[\s-]+", "", s).replace("O", "0")
    s = re.sub(r"[.,]0+$", "", s)
    s = re.split(r"[-\s]", s)[0]
    if not s.isdigit() or len(s) > 5:
        return ""
    return s.zfill(5) if len(s) >= 2 else ""


def town_key(text: str | None) -> str:
    """A town as written: letters and spaces of the part before a comma, without a state code after it."""
    s = fold((text or "").split(",")[0])
    return " ".join(re.sub(r"[^a-z0-9 ]+", " ", s).split())


_UNIT_AT = re.compile(rf"(?:^|(?<=[\s,]))(?:(?:{'|'.join(sorted(UNIT_OF, key=len, reverse=True))})\b\.?\s*#?\s*|#\s*)([a-z]?\d+[a-z]?|[a-z])\b", re.I)
_POST = re.compile(r"\b(\d{5})(?:-\d{4})?$")


def _is_number(token: str) -> bool:
    return bool(re.fullmatch(r"\d+[a-z]?", token))


def _tokens(text: str) -> list[str]:
    out = []
    for t in re.sub(r"[.;]", " ", text).split():
        t = t.strip("'’\"()-")
        if t:
            out.append(ORDINAL_OF.get(t, t))
    return out


def _street_like(tokens: list[str]) -> bool:
    return any(_is_number(t) for t in tokens) or any(t in TYPE_OF for t in tokens[1:])


def parse(address: str | None) -> list[Parts]:
    """The readings of an address, the likeliest first; [] for null and blank text.

    'No.' reads as north or as the word before a number; a letter or number alone in the last place is a unit. Segments
    between commas that hold neither a number nor a street type are names of a building or town: before the street they are
    dropped, behind it they are kept as towns.
    """
    text = fold(address)
    if not text:
        return []
    base = Parts()
    if (m := _UNIT_AT.search(text)) is not None:
        base.unit = m.group(1)
        text = (text[: m.start()] + " , " + text[m.end() :]).strip()
    segments = [s.strip(" -") for s in re.split(r",|\s-\s", text)]
    segments = [s for s in segments if s and not re.fullmatch(r"[\W_]+", s)]
    street, rest = None, []
    for i, s in enumerate(segments):
        tokens = _tokens(s)
        if street is None:
            if _street_like(tokens) and not (len(tokens) == 1 and len(segments) > i + 1 and not tokens[0].isdigit()):
                street = tokens
            continue
        rest.append(s)
    if street is None:
        if not segments:
            return []
        street, rest = _tokens(segments[-1] if "c/o" in segments[0] or len(segments) > 1 else segments[0]), []
    # a number alone, then its street after a comma
    if len(street) == 1 and _is_number(street[0]) and rest:
        street = street + _tokens(rest.pop(0))
    for s in rest:
        if (m := _POST.search(s)) is not None:
            base.postcode = m.group(1)
            s = s[: m.start()].strip()
        s = re.sub(r"[^a-z0-9 ]+", " ", s).strip()
        if not s:
            continue
        if not base.unit and re.fullmatch(r"[a-z]?\d+[a-z]?|[a-z]", s):
            base.unit = s
        elif len(s) > 2:
            base.towns.append(s)
    return _readings(street, base)


def _readings(tokens: list[str], base: Parts) -> list[Parts]:
    out: list[Parts] = []
    half = "1/2" in tokens
    tokens = [t for t in tokens if t != "1/2"]

    def made(number: str, street: list[str], cost: float) -> None:
        p = Parts(number + (" 1/2" if half else ""), "", list(street), "", base.unit, list(base.towns), base.postcode, cost)
        # a bare unit behind the street type, or a letter that is no direction behind a street without type
        if not p.unit and len(p.words) > 2 and re.fullmatch(r"[a-z]|\d+[a-z]?", p.words[-1]) and p.words[-2] in TYPE_OF:
            p.unit = p.words.pop()
        elif not p.unit and len(p.words) > 1 and re.fullmatch(r"[a-z]", p.words[-1]) and p.words[-1] not in DIRECTION_OF:
            p.unit = p.words.pop()
        if len(p.words) > 1 and p.words[-1] in TYPE_OF:
            p.type_ = TYPE_OF[p.words.pop()]
        elif len(p.words) > 2 and p.words[-1] in DIRECTION_OF and p.words[-2] in TYPE_OF:
            p.direction = DIRECTION_OF[p.words.pop()]
            p.type_ = TYPE_OF[p.words.pop()]
        if len(p.words) > 1 and p.words[0] in DIRECTION_OF:
            p.direction = DIRECTION_OF[p.words.pop(0)]
        if p.words:
            out.append(p)

    if tokens and tokens[0] == "no" and len(tokens) > 1 and _is_number(tokens[1]):
        tokens = tokens[1:]
    if tokens and _is_number(tokens[0]):
        made(tokens[0], tokens[1:], 0.0)
    elif len(tokens) > 1 and _is_number(tokens[-1]):
        street = tokens[:-1]
        if len(street) > 2 and street[-1] == "no":
            street = street[:-1]
        made(tokens[-1], street, 0.1)
    elif len(tokens) > 2 and _is_number(tokens[-2]) and re.fullmatch(r"[a-z]", tokens[-1]) and not base.unit:
        base.unit = tokens[-1]
        made(tokens[-2], tokens[:-2], 0.2)
    else:
        made("", tokens, 1.0)
    # a direction word may be part of the name where no other word is left, which made() keeps; 'no' before a name may be
    # the word for number with the number elsewhere
    for p in list(out):
        if p.direction == "n" and "no" in tokens and p.cost < 1:
            q = Parts(p.number, "", list(p.words), p.type_, p.unit, list(p.towns), p.postcode, p.cost + 2.0)
            out.append(q)
    return sorted(out, key=lambda p: p.cost)
