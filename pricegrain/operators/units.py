"""Problem 2: quantities in different units converted to common ones.

Stated units are read from the field. For a figure alone a calibrated random forest ranks the units of its field, and
description or specifications that give the same figure with a unit confirm one. Amounts are exact decimals in ml, g
and micrometres.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

# --- fixed values: units and their exact size ---
VOLUME = {
    "ml": "1", "millilitre": "1", "millilitres": "1", "cc": "1", "cm3": "1", "cm³": "1",
    "cl": "10", "centilitre": "10", "centilitres": "10", "dl": "100", "decilitre": "100", "decilitres": "100", "décilitre": "100", "décilitres": "100",
    "l": "1000", "lt": "1000", "ltr": "1000", "litre": "1000", "litres": "1000", "liter": "1000", "liters": "1000", "dm3": "1000", "dm³": "1000",
    "hl": "100000", "hectolitre": "100000", "hectolitres": "100000", "m3": "1000000", "m³": "1000000",
    "us gal": "3785.411784", "us gallon": "3785.411784", "gal": "3785.411784", "gallon": "3785.411784", "gallons": "3785.411784",
    "us fl oz": "29.5735295625", "fl oz": "29.5735295625", "us pt": "473.176473", "us qt": "946.352946",
}
WEIGHT = {
    "mg": "0.001", "g": "1", "gr": "1", "gramme": "1", "grammes": "1",
    "kg": "1000", "kgs": "1000", "kilo": "1000", "kilos": "1000", "kilogramme": "1000", "kilogrammes": "1000",
    "t": "1000000", "tonne": "1000000", "tonnes": "1000000",
    "lb": "453.59237", "lbs": "453.59237", "oz": "28.349523125",
}
LENGTH = {
    "µm": "1", "mm": "1000", "millimètre": "1000", "millimètres": "1000", "millimetre": "1000", "millimetres": "1000",
    "cm": "10000", "centimètre": "10000", "centimètres": "10000", "centimetre": "10000", "centimetres": "10000",
    "dm": "100000", "m": "1000000", "mètre": "1000000", "mètres": "1000000", "metre": "1000000", "metres": "1000000",
    "km": "1000000000", '"': "25400", "″": "25400", "''": "25400", "in": "25400", "inch": "25400", "inches": "25400", "pouce": "25400", "pouces": "25400",
    "ft": "304800", "pied": "304800", "pieds": "304800",
}
#: unit in a price label -> (attribute, size of the unit in kg, l, m², m or pieces)
LABEL = {
    "kg": ("per_kg", "1"), "kgs": ("per_kg", "1"), "kilo": ("per_kg", "1"), "kilos": ("per_kg", "1"), "kilogramme": ("per_kg", "1"),
    "g": ("per_kg", "0.001"), "gr": ("per_kg", "0.001"), "gramme": ("per_kg", "0.001"), "grammes": ("per_kg", "0.001"),
    "t": ("per_kg", "1000"), "tonne": ("per_kg", "1000"), "tonnes": ("per_kg", "1000"),
    "l": ("per_l", "1"), "litre": ("per_l", "1"), "litres": ("per_l", "1"), "dm3": ("per_l", "1"), "dm³": ("per_l", "1"),
    "cl": ("per_l", "0.01"), "dl": ("per_l", "0.1"), "hl": ("per_l", "100"), "m3": ("per_l", "1000"), "m³": ("per_l", "1000"),
    "m2": ("per_m2", "1"), "m²": ("per_m2", "1"), "dm2": ("per_m2", "0.01"), "dm²": ("per_m2", "0.01"), "cm2": ("per_m2", "0.0001"), "cm²": ("per_m2", "0.0001"),
    "m": ("per_m", "1"), "mètre": ("per_m", "1"), "metre": ("per_m", "1"), "mètres": ("per_m", "1"), "m lin": ("per_m", "1"), "ml": ("per_m", "1"), "mètre linéaire": ("per_m", "1"),
    "cm": ("per_m", "0.01"), "mm": ("per_m", "0.001"), "dm": ("per_m", "0.1"), "km": ("per_m", "1000"),
    "pièce": ("per_piece", "1"), "piece": ("per_piece", "1"), "pièces": ("per_piece", "1"), "pieces": ("per_piece", "1"), "pce": ("per_piece", "1"), "pces": ("per_piece", "1"),
    "pc": ("per_piece", "1"), "pcs": ("per_piece", "1"), "unité": ("per_piece", "1"), "unite": ("per_piece", "1"), "unités": ("per_piece", "1"), "u": ("per_piece", "1"),
    "cent": ("per_piece", "100"), "centaine": ("per_piece", "100"), "mille": ("per_piece", "1000"), "millier": ("per_piece", "1000"), "douzaine": ("per_piece", "12"),
}
# --- end of fixed values ---

DECIMAL = "decimal(24,12)"
NUMBER = r"[0-9]{1,3}(?:[   ][0-9]{3})+(?:[.,][0-9]+)?|[0-9]+(?:[.,][0-9]+)?"
KINDS = {"volume": VOLUME, "weight": WEIGHT, "dimensions": LENGTH}


def _longest_first(words: dict) -> str:
    return "|".join(w.replace(".", r"\.") for w in sorted(words, key=lambda w: (-len(w), w)))


def plain(text: str | Column) -> Column:
    """Lower case, every white space one space, trimmed."""
    text = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(F.lower(text), r"[\s   ]+", " "))


def number(text: Column) -> Column:
    """A figure as decimal: grouped thousands, comma or point, or an inch fraction such as `1 3/8`."""
    bare = F.regexp_replace(F.regexp_replace(text, r"[   ]", ""), ",", ".").try_cast(DECIMAL)
    whole = F.regexp_extract(text, r"^(?:([0-9]+) )?([0-9]+)/([0-9]+)$", 1)
    top = F.regexp_extract(text, r"^(?:([0-9]+) )?([0-9]+)/([0-9]+)$", 2)
    bottom = F.regexp_extract(text, r"^(?:([0-9]+) )?([0-9]+)/([0-9]+)$", 3)
    fraction = F.coalesce(F.nullif(whole, F.lit("")).cast(DECIMAL), F.lit(0).cast(DECIMAL)) + F.try_divide(
        top.try_cast("decimal(10,0)"), F.nullif(bottom.try_cast("decimal(10,0)"), F.lit(0).cast("decimal(10,0)"))
    ).cast(DECIMAL)
    return F.when(bottom != "", fraction).otherwise(bare).cast(DECIMAL)


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once, although `use` may name it many times."""
    return F.element_at(F.transform(F.array(value), use), 1)


def factor(unit: Column, sizes: dict[str, str]) -> Column:
    """Size of a unit word as decimal, null for an unknown word."""
    table = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(v).cast(DECIMAL))])
    return F.try_element_at(table, unit)


def _figure_and_unit(field: Column, sizes: dict[str, str]) -> tuple[Column, Column]:
    pattern = rf"^(?:env\.?|environ|±|~|ca\.?|approx\.?|≈)? ?({NUMBER}) ?({_longest_first(sizes)})?\.?$"
    text = plain(field)
    return F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)


def _parts(field: Column) -> Column:
    """dimensions -> array of (figure, unit); a figure without unit takes the next unit to its right, else to its left."""
    text = F.regexp_replace(plain(field), "″|”|''", '"')
    number_ = rf"[0-9]+ [0-9]+/[0-9]+|[0-9]+/[0-9]+|{NUMBER}"
    label = r"(?:(?:env\.?|±|~|ca\.?|ø|diam\.?|d\.|longueur|largeur|hauteur|épaisseur|profondeur|long\.|larg\.|haut\.|prof\.|lg\.|ép\.|ep\.|l\.|h\.|p\.|l|h|p) ?)*:? ?"
    one = rf"{label}({number_}) ?({_longest_first(LENGTH)})?\.?"
    whole = rf"^{one}(?: ?[x×*] ?{one}){{0,2}}$"
    pieces = F.split(text, r"(?<=[0-9a-zè\"] ?)[x×*](?= ?[^x×*])")
    read = F.transform(pieces, lambda p: F.struct(F.regexp_extract(F.trim(p), rf"^{one}$", 1).alias("figure"), F.regexp_extract(F.trim(p), rf"^{one}$", 2).alias("unit")))
    return F.when(text.rlike(whole) & F.forall(read, lambda x: x["figure"] != ""), read)


@dataclass(frozen=True)
class UnitRules:
    """Bounds of the classifier: training takes at most `sample` rows with a stated unit, chosen by hash of the id."""

    sample: int = 20_000
    trees: int = 20
    depth: int = 8
    precision: float = 0.98  # least calibrated probability of a confident assignment
    seed: int = 7


def read_quantities(products: DataFrame) -> DataFrame:
    """One row for each product and field with a figure: id, field, figures, units (null where none), text, context.

    Words such as `N/C`, blank and null fields give no row.
    """
    parts = []
    context = ["category_id", "unit", "name"]
    text = plain(F.concat_ws(" . ", "description", "specifications"))
    for field, sizes in KINDS.items():
        if field == "dimensions":
            read = _parts(F.col(field))
        else:
            figure, unit = _figure_and_unit(F.col(field), sizes)
            read = F.when(figure != "", F.array(F.struct(figure.alias("figure"), unit.alias("unit"))))
        parts.append(products.select("id", F.lit(field).alias("field"), read.alias("read"), text.alias("text"), *context).filter("read is not null"))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    last = F.reduce("read", F.lit(""), lambda a, x: F.when(x["unit"] != "", x["unit"]).otherwise(a))
    # from right to left, a figure without a unit takes the unit found last
    back = F.reduce(
        F.reverse("read"),
        F.struct(last.alias("unit"), F.array().cast("array<string>").alias("units")),
        lambda a, x: F.struct(
            F.when(x["unit"] != "", x["unit"]).otherwise(a["unit"]).alias("unit"),
            F.concat(F.array(F.when(x["unit"] != "", x["unit"]).otherwise(a["unit"])), a["units"]).alias("units"),
        ),
    )
    return rows.select(
        "id", "field", F.transform("read", lambda x: number(x["figure"])).alias("figures"),
        F.when(last != "", back["units"]).alias("units"), F.when(last == "", F.col("text")).alias("text"), *context,
    )


def _reader(pattern: str, figures: int, unit: int):
    """A function from a matched text to its figures and unit, by the groups of the pattern."""

    def read(match: Column) -> Column:
        run = F.split(F.regexp_extract(match, pattern, figures), r" ?[x×*] ?")
        return F.struct(F.transform(run, lambda n: number(n)).alias("figures"), F.regexp_extract(match, pattern, unit).alias("unit"))

    return read


def stated_elsewhere(rows: DataFrame) -> Column:
    """The units that description or specifications give with the same figures, in their order, for rows of `read_quantities`."""
    found = F.array().cast("array<string>")
    for field, sizes in KINDS.items():
        units = _longest_first(sizes)
        run = rf"(?:{NUMBER})(?: ?[x×*] ?(?:{NUMBER}))*"
        after = rf"(?<![0-9.,])({run}) ?({units})(?![a-zà-ÿ0-9²³])"
        before = rf"\(en ({units})\) ?: ?({run})"
        hits = F.concat(
            F.transform(F.regexp_extract_all("text", F.lit(after), 0), _reader(after, 1, 2)),
            F.transform(F.regexp_extract_all("text", F.lit(before), 0), _reader(before, 2, 1)),
        )
        same = F.filter(hits, lambda h: h["figures"] == F.col("figures"))
        found = F.when(F.col("field") == field, F.array_distinct(F.transform(same, lambda h: h["unit"]))).otherwise(found)
    return found


def _size(unit: Column) -> Column:
    out = F.lit(None).cast(DECIMAL)
    for field, sizes in KINDS.items():
        out = F.when(F.col("field") == field, factor(unit, sizes)).otherwise(out)
    return out


#: Classes of the classifier: a unit for each size that the units of a field have, the first word of that size.
CLASSES = [(field, word) for field, sizes in KINDS.items() for i, (word, size) in enumerate(sizes.items()) if size not in list(sizes.values())[:i]]


def _class_of(unit: Column) -> Column:
    """The class of a unit word of the row's field, null for an unknown one."""
    out = F.lit(None).cast("int")
    for field, sizes in KINDS.items():
        first = {size: i for i, (f, word) in reversed(list(enumerate(CLASSES))) if f == field for size in [sizes[word]]}
        table = F.create_map(*[x for word, size in sizes.items() for x in (F.lit(word), F.lit(first[size]))])
        out = F.when(F.col("field") == field, F.try_element_at(table, unit)).otherwise(out)
    return out


#: Nominal features, as hashes into so many values; the last value is for null.
NOMINAL = {"f_field": 3, "f_category": 64, "f_unit": 16, "f_kind": 64}


def _features(rows: DataFrame) -> DataFrame:
    """Magnitude, source, category and neighbouring fields; what is a name is marked as nominal, so that no order is read into it."""
    name_number = F.regexp_extract(plain("name"), rf"({NUMBER}) ?(?:ml|cl|l|litres?|kg|kilos?|g|gr|mm|cm|m)?(?![a-z0-9])", 1)
    figure = F.element_at("figures", 1).cast("double")
    in_name = number(F.nullif(name_number, F.lit(""))).cast("double")
    log = lambda x: F.coalesce(F.log10(F.when(x > 0, x)), F.lit(-9.0))

    def nominal(name: str, value: Column) -> Column:
        n = NOMINAL[name]
        hashed = value if name == "f_field" else F.when(value.isNotNull(), F.pmod(F.xxhash64(value), F.lit(n))).otherwise(n)
        return hashed.cast("double").alias(name, metadata={"ml_attr": {"type": "nominal", "num_vals": n + 1}})

    return rows.select(
        "*",
        log(figure).alias("f_magnitude"),
        (figure != F.floor(figure)).cast("double").alias("f_fraction"),
        log(F.array_max(F.transform("figures", lambda x: x.cast("double")))).alias("f_largest"),
        F.size("figures").cast("double").alias("f_parts"),
        nominal("f_field", F.when(F.col("field") == "volume", 0).when(F.col("field") == "weight", 1).otherwise(2)),
        nominal("f_category", F.col("category_id")),
        nominal("f_unit", F.col("unit")),
        nominal("f_kind", F.nullif(F.regexp_extract(plain("name"), r"^(\S+)", 1), F.lit(""))),
        log(in_name).alias("f_in_name"),
        (log(figure) - log(in_name)).alias("f_ratio"),
    )


FEATURES = ["f_magnitude", "f_fraction", "f_largest", "f_parts", *NOMINAL, "f_in_name", "f_ratio"]


def isotonic(bins: list[tuple[float, int, int]]) -> list[tuple[float, float]]:
    """(least score, share right) steps that never fall, from (score, right, n) by ascending score: pooled adjacent violators."""
    pooled: list[list] = []
    for score, right, n in bins:
        pooled.append([score, right, n])
        while len(pooled) > 1 and pooled[-2][1] * pooled[-1][2] >= pooled[-1][1] * pooled[-2][2]:
            _, r, m = pooled.pop()
            pooled[-1][1] += r
            pooled[-1][2] += m
    return [(score, right / (n + 1)) for score, right, n in pooled]  # one more that was wrong: few rows make no certainty


@dataclass(frozen=True)
class UnitModel:
    """The forest and the steps that turn its largest vote into a probability of being right."""

    forest: PipelineModel
    steps: tuple

    def propose(self, rows: DataFrame) -> DataFrame:
        """Adds votes (of each class), guess (a unit of the row's field) and probability (calibrated)."""
        out = self.forest.transform(_features(rows)).withColumn("votes", vector_to_array("probability"))
        top = F.array_max("votes")
        calibrated = F.lit(0.0)
        for score, p in self.steps:
            calibrated = F.when(top >= score, F.lit(float(p))).otherwise(calibrated)
        guess = F.lit(None).cast("string")
        for i, (field, word) in enumerate(CLASSES):
            guess = F.when((F.col("prediction") == i) & (F.col("field") == field), F.lit(word)).otherwise(guess)
        return out.select(*rows.columns, "votes", guess.alias("guess"), calibrated.alias("probability"))


def train_unit_model(rows: DataFrame, rules: UnitRules = UnitRules()) -> UnitModel | None:
    """The classifier from rows whose field states one unit, by whatever unit they state.

    A held-out fifth calibrates it: the largest vote is binned, and the share of right answers of the bins, made
    monotone (isotonic regression), is the probability. Without two classes, or with fewer rows than a nominal
    feature has values, there is no model.
    """
    labelled = rows.filter(F.col("units").isNotNull() & (F.size(F.array_distinct("units")) == 1)).withColumn("label", _class_of(F.element_at("units", 1)).cast("double")).filter("label is not null")
    sample = _features(labelled.orderBy(F.xxhash64("id", "field"), "id", "field").limit(rules.sample)).select("id", "label", *FEATURES).cache()
    try:
        held = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)) == 0
        n, classes = sample.filter(~held).agg(F.count(F.lit(1)), F.count_distinct("label")).head()
        if classes < 2 or n < max(NOMINAL.values()) + 2:
            return None
        forest = RandomForestClassifier(numTrees=rules.trees, maxDepth=rules.depth, seed=rules.seed, maxBins=max(NOMINAL.values()) + 2)
        model = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(sample.filter(~held))
        top = F.floor(F.array_max(vector_to_array("probability")) * 50) / 50
        bins = model.transform(sample.filter(held)).groupBy(top.alias("bin")).agg(F.count_if(F.col("prediction") == F.col("label")).alias("right"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    finally:
        sample.unpersist()
    return UnitModel(model, tuple(isotonic([(r["bin"], r["right"], r["n"]) for r in bins])))  # at most 51 bins


def convert_products(products: DataFrame, rules: UnitRules = UnitRules()) -> DataFrame:
    """One row for each quantity of a product: id, attribute, amount (ml, g, µm), unit, status, probability.

    For a figure alone the classifier ranks the units of its field; a unit that description or specifications give
    with the same figures confirms the proposal, of several such units the one it ranks first. status: stated (the
    field has the unit), confirmed, inferred (no text gives it, the classifier is confident) or review (it is not;
    amount null). Attributes are volume, weight, dim1, dim2, dim3. Texts without a figure give no row.
    """
    rows = written(read_quantities(products))
    model = train_unit_model(rows, rules)
    known = rows.filter("units is not null").select(
        "id", "field", "figures", "units", F.lit("stated").alias("status"), F.lit(None).cast("double").alias("probability")
    )
    missing = rows.filter("units is null")
    if model is not None:
        missing = model.propose(missing)
    else:
        missing = missing.select("*", F.lit(None).cast("array<double>").alias("votes"), F.lit(None).cast("string").alias("guess"), F.lit(None).cast("double").alias("probability"))
    missing = missing.withColumn("given", stated_elsewhere(missing))
    vote = lambda u: F.coalesce(F.get("votes", _class_of(u)), F.lit(0.0))
    ranked = F.array_max(F.transform("given", lambda u, i: F.struct(vote(u).alias("vote"), (-i).alias("place"), u.alias("unit"))))
    missing = missing.withColumn("evidence", ranked["unit"]).withColumn("guess", F.when(F.col("probability") >= rules.precision, F.col("guess")))
    unit = F.coalesce("evidence", "guess")
    solved = missing.select(
        "id", "field", "figures", F.transform("figures", lambda _: unit).alias("units"),
        F.when(F.col("evidence").isNotNull(), "confirmed").when(F.col("guess").isNotNull(), "inferred").otherwise("review").alias("status"),
        "probability",
    )
    each = known.unionByName(solved).select("id", "field", "status", "probability", F.posexplode(F.arrays_zip("figures", "units")).alias("at", "q"))
    attribute = F.when(F.col("field") == "dimensions", F.concat(F.lit("dim"), (F.col("at") + 1).cast("string"))).otherwise(F.col("field"))
    amount = F.round(F.col("q.figures").cast("decimal(18,6)") * _size(F.col("q.units")).cast("decimal(20,10)"), 0).cast("long")
    return each.select("id", attribute.alias("attribute"), amount.alias("amount"), F.col("q.units").alias("unit"), "status", "probability")


def masked_accuracy(products: DataFrame, rules: UnitRules = UnitRules()) -> dict[str, float]:
    """How the classifier does on a fifth of the stated quantities whose units it is not shown: share confident, accuracy of those and of all."""
    rows = written(read_quantities(products))
    test = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(5)) == 0
    model = train_unit_model(rows.filter(~test), rules)
    said = model.propose(rows.filter(test & F.col("units").isNotNull() & (F.size(F.array_distinct("units")) == 1)))
    sure, right = F.col("probability") >= rules.precision, F.coalesce(_class_of(F.col("guess")) == _class_of(F.element_at("units", 1)), F.lit(False))
    n, confident, confident_right, all_right = said.agg(F.count(F.lit(1)), F.count_if(sure), F.count_if(sure & right), F.count_if(right)).head()
    return {"n": n, "confident": confident / max(n, 1), "accuracy": confident_right / max(confident, 1), "overall": all_right / max(n, 1)}


def convert_unit_prices(listings: DataFrame) -> DataFrame:
    """id, attribute (per_kg, per_l, per_m2, per_m, per_piece), amount (cents for one such unit) of listings.

    Rows without unit_price, or whose unit_label names no quantity (none, a tax, a bag, a day), give no row.
    `ml` is a running metre unless a figure stands before it.
    """
    label = plain("unit_label")
    label = F.regexp_replace(label, r"€|\beuros?\b|\beur\b|\bht\b|\bttc\b", " ")
    label = F.trim(F.regexp_replace(F.regexp_replace(label, r"[/.]|\b(?:par|les|le|la|pour)\b|\bl[’']", " "), r" +", " "))
    figured = rf"^(?:lot de |boîte de |paquet de )?({NUMBER}) ?({_longest_first(LABEL)})?$"
    attributes = F.create_map(*[x for k, v in LABEL.items() for x in (F.lit(k), F.lit(v[0]))])
    sizes = {k: v[1] for k, v in LABEL.items()}

    def split(text: Column) -> Column:
        figure = F.regexp_extract(text, figured, 1)
        return F.struct(figure.alias("figure"), F.when(figure == "", text).otherwise(F.regexp_extract(text, figured, 2)).alias("word"))

    def read(part: Column) -> Column:
        figure, word = part["figure"], part["word"]
        pieces, millilitre = (figure != "") & (word == ""), (figure != "") & (word == "ml")
        attribute = F.when(millilitre, F.lit("per_l")).when(pieces, F.lit("per_piece")).otherwise(F.try_element_at(attributes, word))
        unit = F.when(millilitre, F.lit("0.001").cast(DECIMAL)).when(pieces, F.lit(1).cast(DECIMAL)).otherwise(factor(word, sizes))
        count = F.when(figure != "", number(figure)).otherwise(F.lit(1).cast(DECIMAL))
        return F.struct(attribute.alias("attribute"), (count.cast("decimal(14,4)") * unit.cast("decimal(14,6)")).alias("size"))

    parsed = _let(_let(label, split), read)
    priced = listings.filter("unit_price is not null and unit_label is not null").select("id", "unit_price", parsed.alias("parsed"))
    amount = F.round(F.try_divide((F.col("unit_price").cast("decimal(14,2)") * 100).cast("decimal(16,0)"), F.col("parsed.size")), 0).cast("long")
    out = priced.select("id", "unit_price", "parsed.attribute", amount.alias("amount"))
    return out.filter("unit_price is not null and attribute is not null and amount is not null").drop("unit_price")
