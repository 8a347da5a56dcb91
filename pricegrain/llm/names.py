"""Reading of catalogue names into kind, brand, range, sizes, traits and pack."""

from __future__ import annotations

import html
import re
import unicodedata
from dataclasses import dataclass

# --- fixed values: words of the trade ---
#: kind of article -> words of which one names it; the first kind found counts
KINDS = [
    ("facade paint", ["facade"]), ("wood stain", ["lasure"]), ("varnish", ["vernis", "vitrificateur"]), ("silicone", ["silicone"]),
    ("tile adhesive", ["mortier", "ciment"]), ("filler", ["enduit"]), ("concrete", ["beton"]), ("tile", ["cerame"]), ("deck board", ["lame"]),
    ("insulation", ["isolant", "isolation"]), ("plasterboard", ["platre", "platree"]), ("ladder", ["echelle"]), ("drill", ["perceuse", "visseuse"]),
    ("tap", ["mitigeur"]), ("spotlight", ["led"]), ("lock", ["serrure"]), ("cable", ["cable"]), ("copper", ["cuivre"]), ("disc", ["disque"]),
    ("plug", ["cheville", "chevilles"]), ("screw", ["vis"]), ("paint", ["peinture", "peint"]), ("glue", ["colle"]),
]
#: words of one trait -> its name
TRAITS = {
    "mat": "mat", "mate": "mat", "matte": "mat", "satin": "satin", "satine": "satin", "satinee": "satin", "brillant": "brillant", "brillante": "brillant",
    "brill": "brillant", "velours": "velours", "anthr": "anthracite", "droite": "right", "gauche": "left", "reversible": "reversible", "haut": "high", "bas": "low", "cascade": "cascade",
    "gris": "gris", "clair": "clair", "anthracite": "anthracite", "perle": "perle", "blanc": "blanc", "noir": "noir", "beige": "beige", "rouge": "rouge", "brique": "brique",
    "bleu": "bleu", "nuit": "nuit", "vert": "vert", "sauge": "sauge", "wenge": "wenge", "teck": "teck", "hetre": "hetre", "acajou": "acajou", "chene": "chene", "merisier": "merisier",
    "noyer": "noyer", "transparent": "transparent", "pin": "pin", "laiton": "laiton", "vieilli": "vieilli", "chrome": "chrome", "nickel": "nickel", "brosse": "brosse",
    "ivoire": "ivoire", "taupe": "taupe", "jaune": "jaune", "ardoise": "ardoise", "sable": "sable",
}
FINISHES = {"mat", "satin", "brillant", "velours"}
FORMS = {"high", "low", "cascade", "left", "right", "reversible"}
SUFFIXES = {"eco", "premium", "plus", "evo", "basic"}
# --- end of fixed values ---

#: word -> rank of its kind
_KIND_OF = {w: i for i, (_, words) in reversed(list(enumerate(KINDS))) for w in words}
_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
KNOWN = {w for _, words in KINDS for w in words} | set(TRAITS) | SUFFIXES

_N = r"(\d+(?:\.\d+)?)"
_U = r"\s?(mm|cm|m|millimetres?|centimetres?|metres?)?"
_LEN = {"mm": 1, "cm": 10, "m": 1000, "millimetre": 1, "millimetres": 1, "centimetre": 10, "centimetres": 10, "metre": 1000, "metres": 1000}
_VOL = {"ml": 1, "cl": 10, "l": 1000, "litre": 1000, "litres": 1000}
_WEIGHT = {"kg": 1000, "kilo": 1000, "kilos": 1000, "g": 1, "gr": 1, "gramme": 1, "grammes": 1}
_PROMO = re.compile(r"garantie \d+ ans|-\d+ ?%")
_PACK = re.compile(r"(?<![a-z])(?:lot de|boite de|bte|paquet de|par|x)\s?(\d+)(?![\d.]*\s?(?:mm|cm|m\b|x\s?\d))|(?<![\d.x])(\d+)\s?(?:pieces?|pcs|unites?)\b")
_CABLE = re.compile(r"(\d)\s?g\s?(\d+(?:\.\d+)?)(?:\s?mm2?)?")
_DIMS = re.compile(rf"(?:ø\s?)?(?<![\d.]){_N}{_U}\s?(?:x|(?<=\d)\s?(?:lg|l|longueur)\.?\s)\s?{_N}{_U}(?:\s?x\s?{_N}{_U})?(?![\w])")
_ROUND = re.compile(rf"ø\s?{_N}{_U}\s?(?:x|lg\.?|l\.?|longueur)\s?{_N}{_U}")
_RUNGS = re.compile(r"(?:(\d)\s?x\s?)?(\d+)\s?(?:barreaux|echelons|marches)")
_PLAIN = [
    (re.compile(rf"{_N}\s?(ml|cl|litres?|l)\b"), "v", _VOL), (re.compile(rf"{_N}\s?(kg|kilos?|gr|grammes?|g)\b"), "w", _WEIGHT),
    (re.compile(rf"{_N}\s?(?:volts?|v)\b"), "volt", None), (re.compile(rf"{_N}\s?ah\b"), "ah", None), (re.compile(rf"{_N}\s?(?:watts?|w)\b"), "watt", None),
    (re.compile(rf"{_N}\s?k\b"), "kelvin", None), (re.compile(rf"axe\s?{_N}"), "axe", None), (re.compile(rf"{_N}\s?(m|metres?|cm|mm)\b"), "len", _LEN),
]


@dataclass(frozen=True)
class Article:
    """What a name says; empty where it says nothing."""

    kind: str
    brand: str
    range: str
    suffix: str
    sizes: tuple
    traits: frozenset
    pack: str


def fold(text: str) -> str:
    """Lower case without accents and entities; figures with points, `x` between them."""
    text = unicodedata.normalize("NFKD", html.unescape(text).lower().replace("×", "x").replace("œ", "oe").replace("²", "2").replace(" ", " ").replace("\xa0", " "))
    text = _MARKS.sub("", text)
    text = re.sub(r"(?<=\d),(?=\d)", ".", text)
    text = re.sub(r"(?<=\d) (?=\d{3}(?:\D|$)\s?(?:ml|g|mm))", "", text)
    return re.sub(r"\s+", " ", text).strip()


def _num(x: str) -> str:
    v = round(float(x), 4)
    return str(int(v)) if v == int(v) else str(v)


def read_name(name: str | None, common: frozenset, brands: dict[str, str]) -> Article:
    """Parts of a name. `common` are the words many names have, `brands` folded brand words -> brand.

    What is neither common nor a figure is the range; several such words are joined. A name without a known kind is
    of the kind of its first common word; one without any word has no kind.
    """
    text = _PROMO.sub(" ", fold(name or ""))
    sizes: list[tuple[str, str]] = []
    pack = ""

    def take(pattern, use):
        nonlocal text
        m = pattern.search(text)
        if m:
            end = use(m) or m.end()
            text = text[: m.start()] + " " + text[end:]
        return bool(m)

    def dims(m):
        groups, end = m.groups(), None
        if len(groups) > 4 and groups[4] and not groups[5]:
            # a third figure is a pack if the unit came before it, or it is written with its x apart from the others
            apart = re.search(r"\sx$", text[: m.start(5)]) and not re.search(r"\sx$", text[: m.start(3)])
            if groups[3] or apart:
                groups, end = groups[:4], m.start(5) - 1
        values = [(groups[i], groups[i + 1]) for i in range(0, len(groups), 2) if groups[i]]
        last = next((u for _, u in reversed(values) if u), "mm")
        sizes.append(("dim", "x".join(_num(str(float(v) * _LEN[u or last])) for v, u in values)))
        return end

    take(_CABLE, lambda m: sizes.append(("wire", f"{m[1]}g{_num(m[2])}")))
    take(_RUNGS, lambda m: sizes.append(("rungs", m[2])))
    if not take(_ROUND, dims):
        take(_DIMS, dims)

    def packed(m):
        nonlocal pack
        pack = str(int(m[1] or m[2]))

    take(_PACK, packed)
    for pattern, what, table in _PLAIN:
        take(pattern, lambda m, what=what, table=table: sizes.append((what, _num(str(float(m[1]) * table[m[2]])) if table else _num(m[1]))))
    words = re.findall(r"[a-z]+", text)
    present = set(words)
    rank = min((_KIND_OF[w] for w in words if w in _KIND_OF), default=None)
    if rank is not None:
        kind = KINDS[rank][0]
    else:
        kind = next((f"other: {w}" for w in words if w in common and len(w) >= 4 and w not in TRAITS), "other" if words else "")
    if kind == "glue" and "carrelage" in present:
        kind = "tile adhesive"
    traits = {TRAITS[w] for w in words if w in TRAITS}
    if "d" in present and "g" in present:
        traits.add("reversible")
    if kind not in ("tap", "lock"):
        traits -= {"high", "low", "right", "left", "reversible", "cascade"}
    if kind in ("glue", "filler", "concrete", "screw", "plug", "disc"):
        traits = set()
    brand = next((brands[w] for w in words if w in brands), "")
    suffix = next((w for w in words if w in SUFFIXES), "")
    own = brand.split()
    rare = [w for w in words if w not in common and w not in brands and w not in own and w not in KNOWN and len(w) >= 4]
    pack = "" if pack == "1" else pack
    return Article(kind, brand, "".join(rare[:2]), suffix, tuple(sorted(set(sizes))), frozenset(traits), pack)


def near(a: str, b: str) -> bool:
    """Equal, or one letter added, left out, changed or exchanged with its neighbour."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 5:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]
