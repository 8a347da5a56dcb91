"""Technical fields read from product names: one first match per field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: vocabularies, patterns and labels ---
COLORS = [
    "blanc", "noir", "gris", "rouge", "bleu", "vert", "jaune", "orange", "marron", "beige", "rose", "violet", "turquoise", "anthracite", "ardoise",
    "ivoire", "crème", "taupe", "sable", "pierre", "terracotta", "terre cuite", "brique", "rouille", "chocolat", "cappuccino", "lin", "grège",
    "chêne", "noyer", "pin", "hêtre", "acajou", "teck", "wengé", "merisier", "bouleau", "érable", "ébène", "chromé", "doré", "argenté", "bronze",
    "cuivré", "nickel", "inox", "gris clair", "gris foncé", "gris anthracite", "gris perle", "bleu nuit", "bleu canard", "vert olive", "vert sauge",
    "blanc cassé", "blanc nacré", "noir mat",
]
FINISHES = [
    "satin", "satinée", "satiné", "mat", "mate", "matte", "brillant", "brillante", "velours", "laqué", "laquée", "brossé", "brossée", "poli", "polie",
    "brut", "brute", "verni", "vernie", "texturé", "texturée", "monocouche", "bicouche",
]
FINISH_NAMES = {"satinée": "satin", "satiné": "satin", "mate": "mat", "matte": "mat", "brillante": "brillant"}
MATERIALS = [
    "inox", "acier inoxydable", "acier galvanisé", "acier zingué", "acier", "galvanisé", "zingué", "pvc", "polyéthylène", "polypropylène", "abs",
    "cuivre", "laiton", "bronze", "aluminium", "alu", "zinc", "fonte", "bois massif", "bois", "plâtre", "ba13", "ba10", "ba15", "béton", "ciment",
    "mortier", "grès cérame", "grès", "faïence", "céramique", "porcelaine", "verre trempé", "verre", "fibre de verre", "polystyrène",
    "laine de verre", "laine de roche", "multicouche", "per",
]
NUMBER = r"[0-9]+(?:[.,][0-9]+)?"
COUNTED = r"(?:pièces?|pi[eè]ces?|pcs|vis|chevilles|clous|unités?|rouleaux?|plaques?|tubes?|embouts?|douilles?|forets?|lames?|feuilles?)"
#: field -> (pattern of the whole match, whether letter case is ignored); RE2 and Java read them alike
PATTERNS = {
    "volume": (rf"{NUMBER}\s*(?:L|l|ml|cl|litres?)\b", False),
    "dimensions": (rf"{NUMBER}\s*[xX×]\s*{NUMBER}(?:\s*[xX×]\s*{NUMBER})?\s*(?:mm|cm|m)?\b", False),
    "diameter": (rf"[Øø]\s*{NUMBER}\s*(?:mm|cm)?", False),
    "thickness": (rf"[éeÉ]p(?:aisseur)?\.?\s*{NUMBER}\s*(?:mm|cm)", True),
    "length": (rf"[Ll](?:ong(?:ueur)?)?\.?\s*{NUMBER}\s*(?:m|cm|mm)\b", False),
    "battery": (rf"{NUMBER}\s*Ah\b", False),
    "pack_size": (rf"(?:lot|pack|boîte|bte|sachet|seau|sac|carton|palette)\s*(?:de\s*)?[0-9\s]+[0-9]|[0-9][0-9\s]*[0-9]\s*{COUNTED}\b|[0-9]+\s*{COUNTED}\b", True),
    "grain": (r"\b(?:grain|gr\.?)\s*[0-9]+\b|P\s*[0-9]{2,4}\b", True),
    "torque": (rf"{NUMBER}\s*N\.?m\b", False),
    "speed": (r"[0-9][0-9\s]*[0-9]\s*(?:tr/min|rpm|tours/min)\b", True),
    "chuck": (rf"mandrin\s*(?:de\s*)?{NUMBER}\s*mm", True),
    "key_size": (rf"(?:clé|cle|clés|douille)\s*(?:de\s*)?{NUMBER}\s*(?:mm|\")?", True),
    "drive_size": (r"\b(?:1/4|3/8|1/2|3/4)\s*[\"″]?\b", False),
    "teeth": (r"[0-9]+\s*(?:dents|dts)\b", True),
    "max_load": (r"(?:charge|maxi?\.?)\s*[0-9]+\s*kg", True),
    "steps": (r"[0-9]+\s*(?:marches?|échelons?|barreaux?)", True),
    "pressure": (rf"{NUMBER}\s*(?:bars?|PSI)\b", True),
    "section": (rf"{NUMBER}\s*mm[²2]", False),
    "ip_rating": (r"\bIP\s*[0-9]{2}\b", False),
    "bit_type": (r"\b(?:PH[0-4]|PZ[0-4]|Torx\s*T?[0-9]+|T[0-9]{1,2}|SL\s*[0-9]+|6\s*pans?\s*[0-9]+|BTR\s*[0-9]+|hexagonale?\s*[0-9]+|plate?|cruciforme|phillips|pozidri[vx])\b", True),
}
#: fields that are read from the name in small letters
SMALL = ["chuck", "key_size", "teeth", "max_load", "steps"]
WEIGHT_KG, WEIGHT_G = rf"{NUMBER}\s*kg\b", r"[0-9]{2,}\s*g\b"
POWER = r"(?:^|[^A-Za-z0-9])([0-9]+\s*(?:V|W|kW))\b"
AMPERAGE = r"[0-9]+\s*A\b"
#: ordered (part of the name, label); the first part found counts; those of tool_type are patterns of whole words
LABELS = {
    "tool_type": [
        ("sans fil", "sans fil"), ("filaire", "filaire"), ("à percussion", "percussion"), ("percussion", "percussion"), ("à cliquet", "à cliquet"),
        ("cliquet", "à cliquet"), ("pneumatique", "pneumatique"), ("hydraulique", "hydraulique"), ("sds-?plus", "SDS-Plus"), ("sds-?max", "SDS-Max"),
        ("brushless", "brushless"),
    ],
    "saw_type": [
        ("scie sauteuse", "sauteuse"), ("scie circulaire", "circulaire"), ("scie sabre", "sabre"), ("scie cloche", "cloche"), ("scie à onglet", "à onglet"),
        ("scie sur table", "sur table"), ("scie à ruban", "à ruban"), ("scie à métaux", "à métaux"), ("scie égoïne", "égoïne"), ("scie plongeante", "plongeante"),
    ],
    "plier_type": [
        ("pince coupante", "coupante"), ("pince multiprise", "multiprise"), ("pince à bec", "bec long"), ("pince bec long", "bec long"),
        ("pince à sertir", "à sertir"), ("pince à dénuder", "à dénuder"), ("pince étau", "étau"), ("pince universelle", "universelle"),
        ("pince à circlips", "circlips"), ("pince multifonctions", "multifonctions"),
    ],
    "drill_type": [
        ("foret béton", "béton"), ("foret bois", "bois"), ("foret métal", "métal"), ("foret multi", "multi-matériaux"), ("foret sds", "SDS"),
        ("foret à étage", "à étage"), ("mèche bois", "bois"), ("mèche béton", "béton"), ("trépan", "trépan"),
    ],
    "disc_type": [
        ("disque diamant", "diamant"), ("disque tronçonnage", "tronçonnage"), ("disque à tronçonner", "tronçonnage"), ("disque meulage", "meulage"),
        ("disque à meuler", "meulage"), ("disque à lamelles", "lamelles"), ("disque abrasif", "abrasif"),
    ],
}
# --- end of fixed values ---

def _match(name: Column, pattern: str, ignore: bool = False, group: int = 0) -> Column:
    return F.nullif(F.trim(F.regexp_extract(name, ("(?iu)" if ignore else "") + pattern, group)), F.lit(""))


def _term(name: Column, terms: list[str]) -> Column:
    """The first term of the list that stands in the name between other than word characters."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(name), rf"(?u)[^0-9a-zà-öø-ÿœ_]", " "), F.lit(" "))
    words = F.array(*[F.lit(t) for t in terms])
    # the padded name is bound once, not computed again for each term
    found = F.transform(F.array(padded), lambda p: F.try_element_at(F.filter(words, lambda t: F.contains(p, F.concat(F.lit(" "), t, F.lit(" ")))), F.lit(1)))
    return F.element_at(found, 1)


def longest_first(terms: list[str]) -> list[str]:
    return sorted(terms, key=lambda t: -len(t))


def _label(name: Column, rules: list[tuple[str, str]], whole: bool) -> Column:
    low, out = F.lower(name), F.lit(None).cast("string")
    for part, label in reversed(rules):
        out = F.when(low.rlike(rf"(?U)\b{part}\b") if whole else F.contains(low, F.lit(part)), F.lit(label)).otherwise(out)
    return out


def field(name: Column, which: str) -> Column:
    """One field of a name, null where it is not in it."""
    if which in PATTERNS:
        return _match(F.lower(name) if which in SMALL else name, *PATTERNS[which])
    if which == "weight":
        return F.coalesce(_match(name, WEIGHT_KG, True), _match(name, WEIGHT_G))
    if which == "power":
        found = _match(name, POWER, False, 1)
        return F.when(F.regexp_extract(found, "^[0-9]+", 0).try_cast("int") >= 10, found)
    if which == "amperage":
        return F.when(field(name, "battery").isNull(), _match(name, AMPERAGE))
    if which == "color":
        return _term(name, longest_first(COLORS))
    if which == "material":
        return _term(name, longest_first(MATERIALS))
    if which == "finish":
        base = F.create_map(*[F.lit(x) for pair in FINISH_NAMES.items() for x in pair])
        return F.element_at(F.transform(F.array(_term(name, FINISHES)), lambda t: F.coalesce(F.try_element_at(base, t), t)), 1)
    return _label(name, LABELS[which], which == "tool_type")


FIELDS = [*PATTERNS, "weight", "power", "amperage", "color", "material", "finish", *LABELS]


def specs(name: Column, given: Column | None = None) -> Column:
    """All fields found, as a map; non-blank entries of the map `given` win."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), field(name, k).alias("value")) for k in FIELDS])
    found = F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
    if given is None:
        return found
    own = F.coalesce(F.map_filter(given, lambda _, v: F.coalesce(v != "", F.lit(False))), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(found, lambda k, _: ~F.map_contains_key(own, k))
    return F.map_concat(kept, own)


def key_specs(name: Column) -> Column:
    """The fields that two names of one product must share, in one spelling; the name is computed once."""
    return F.element_at(F.transform(F.array(name), _key_specs), 1)


def _key_specs(name: Column) -> Column:
    tight = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    return F.struct(
        field(name, "color").alias("color"),
        F.replace(tight(field(name, "volume")), F.lit(","), F.lit(".")).alias("volume"),
        tight(field(name, "dimensions")).alias("dimensions"),
        F.replace(tight(field(name, "weight")), F.lit(","), F.lit(".")).alias("weight"),
        field(name, "finish").alias("finish"),
        tight(field(name, "power")).alias("power"),
        F.nullif(F.regexp_extract(field(name, "pack_size"), "[0-9]+", 0), F.lit("")).alias("pack"),
    )


def compatible(a: Column, b: Column) -> Column:
    """No key field is in both and different."""
    out = F.lit(True)
    for name in ("color", "volume", "dimensions", "weight", "finish", "power", "pack"):
        out = out & (a[name].isNull() | b[name].isNull() | (a[name] == b[name]))
    return out
