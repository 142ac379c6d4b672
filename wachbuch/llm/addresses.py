"""Which address records denote the same house.

1. A place line is cut into components: city, street as written, house number, letter. A line that names no city
   belongs to the one that its quarter or district is elsewhere written with; one whose place names are never written with a
   known city belongs to the place it names first.
2. Each street spelling is expanded into its plausible normalised forms: every reading of an
   abbreviated ending, and, for slips of the pen, each form with one letter left out. Two spellings
   that are one insertion, deletion, substitution or swap apart share such a form. An equi-join on
   hashed forms finds a rare form's dominant neighbour.
3. Each distinct address is expanded again, into its combinations of city, street form, number and
   letter; the combinations are hashed and exploded, and an equi-join on any shared hash brings the
   addresses together. An abbreviation with several readings stands for the one that others write in
   full for the same house; where none does, for the one most often written. City, number and letter are part of
   each hash, so conflicting house numbers never meet.
4. Pairs of addresses are expanded to pairs of records last, with crowded houses split into parts.

Work is done on distinct place names, street spellings and addresses, so a line that a third of all
records repeat is handled once. Defined results: NULL or empty lines, lines without a house number and
numbered roads that are no streets name no house and give no rows. Repeated records are paired each on their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wachbuch.llm.normal import collapse, plain
from wachbuch.operators.skew import split_join
from wachbuch.session import cut

#: Endings of street names and how they are abbreviated.
ENDINGS = {
    "strasse": ("str", "s"), "weg": ("w",), "damm": ("d",), "gasse": ("g", "gas"), "allee": ("al", "a"), "platz": ("pl", "p"),
    "chaussee": ("ch", "chau", "chaus"), "ring": ("r",), "kamp": ("k",), "stieg": ("st",), "ufer": ("u",), "brucke": ("br",), "deich": ("dch",),
}
#: Roads that are numbered themselves.
NUMBERED = ("zubringer", "autobahn", "bundesautobahn", "bundestrase", "landestrase", "kreistrase", "a", "b", "l", "k", "bab")
#: Words of a line that are no place names.
NO_PLACE = ("bremen", "bemen", "bremerhaven", "stadt", "haus", "hausnummer", "ortsteil", "stadtteil")
#: A spelling is a slip of another if that one is this many times as frequent.
DOMINANT = 3

#: A component that ends with a house number, up to the next separator.
_HOUSE = r"(?:^|[,/)])\s*([^,/()0-9]*\p{L}\.?)[\s-]*(?:\b(?:nr\.?|no\.?|haus|hausnr\.?|hausnummer)\s*)?(?<![0-9])([0-9]{1,4})\s?([a-z])?\s*(?=$|[,/(])"


def parse(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """``id, city, street, number, letter`` of the lines that name a house."""
    s = plain(F.col(column))
    d = df.select(F.col(id_col).cast("long").alias("id"), s.alias("s")).where("s is not null")
    d = d.select("id", "s", *[F.regexp_extract("s", _HOUSE, k).alias(n) for k, n in ((1, "street"), (2, "number"), (3, "letter"))])
    # what may stand before the street in the same component: district and quarter, or the city
    street = F.regexp_replace("street", r"^.*\bot \S+ ", "")
    street = F.regexp_replace(street, r"^(?:bremen|hb|bremerhaven) +(?=\p{L})", "")
    street = F.regexp_replace(street, r"\s+(?:nr\.?|no\.?|haus|hausnr\.?|hausnummer)$", "")
    # a final dot marks an abbreviation, all other joints are a matter of taste
    dotted = F.regexp_replace(F.regexp_replace(street, r"[^\p{L}.]", ""), r"\.(?=.)", "")
    city = F.when(F.col("s").rlike(r"\bb\p{L}{4,8}haven(?!er)"), "bremerhaven").when(F.col("s").rlike(r"\b(?:bremen|bemen|hb)\b"), "bremen")
    names = F.array_distinct(F.filter(F.regexp_extract_all(F.replace("s", "street", F.lit(" ")), F.lit(r"(\p{L}{3,})"), F.lit(1)), lambda x: ~x.isin(*NO_PLACE)))
    d = d.where("number <> ''").select("id", city.alias("city"), names.alias("names"), dotted.alias("street"), F.col("number").cast("int").alias("number"), "letter")
    return placed(cut(d.where(F.length(F.replace("street", F.lit("."), F.lit(""))) > 1)))


def placed(d: DataFrame) -> DataFrame:
    """Gives lines without a city the one that their place names are most often written with, else their first name."""
    said = d.where("city is not null").groupBy("city", "names").agg(F.count("*").alias("n"))
    usual = said.select("city", "n", F.explode("names").alias("name")).groupBy("name", "city").agg(F.sum("n").alias("n"))
    usual = usual.groupBy("name").agg(F.max(F.struct("n", "city")).alias("u"))
    open_ = d.where("city is null").select("names").distinct()
    told = open_.select("names", F.explode("names").alias("name")).join(usual, "name").groupBy("names").agg(F.max("u").alias("u")).select("names", F.col("u.city").alias("usual"))
    out = d.where("city is null").join(told, "names", "left").withColumn("city", F.coalesce("usual", F.try_element_at("names", F.lit(1)), F.lit("")))
    return d.where("city is not null").drop("names").unionByName(out.drop("names", "usual"))


def readings(street: Column) -> Column:
    """Every full form that a spelling may stand for; the spelling itself if nothing is abbreviated."""
    bare = F.rtrim(street, F.lit("."))
    options = []
    for full, shorts in ENDINGS.items():
        for short in shorts:
            # a bare 'str' is an abbreviation also without its dot; one or two letters need it
            is_short = street.endswith(short + ".") if len(short) < 3 else bare.endswith(short)
            stem = F.left(bare, F.length(bare) - len(short))
            options.append(F.when(is_short & (F.length(stem) > 2), F.concat(stem, F.lit(full))))
    out = F.array_distinct(F.array_compact(F.array(*options)))
    return F.when(F.size(out) > 0, out).otherwise(F.array(bare))


def slips(form: Column) -> Column:
    """The form and each string that it becomes without one letter."""
    return F.concat(F.array(form), F.transform(F.sequence(F.lit(1), F.length(form)), lambda i: F.concat(F.left(form, i - 1), F.substr(form, i + 1))))


def resolve(addresses: DataFrame) -> DataFrame:
    """``city, street, reading, canon, w``: each reading of a street spelling with the form that it most likely stands for, and
    how many records write that.

    ``addresses``: city, street and n, the number of records. A rare form gives way to a neighbour that
    is ``DOMINANT`` times as frequent, one slip away.
    """
    spelled = addresses.groupBy("city", "street").agg(F.sum("n").alias("n"))
    read = cut(spelled.withColumn("readings", readings(F.col("street"))))
    # also with transcribed umlauts and double letters as one letter: a slip may stand in either form
    forms = read.select("city", "street", "n", (F.size("readings") == 1).alias("full"), F.explode("readings").alias("reading"))
    forms = forms.withColumn("form", F.explode(F.array_distinct(F.array("reading", collapse(F.col("reading"))))))
    # how often a form is written is the same in every city of the archive: names recur
    weight = forms.where("full").groupBy("form").agg(F.sum("n").alias("w"))
    every = cut(forms.select("form").distinct().join(weight, "form", "left").withColumn("w", F.coalesce("w", F.lit(0).cast("long"))))
    keyed = every.where(F.length("form") > 4).select("form", "w", F.explode(F.array_distinct(F.transform(slips(F.col("form")), lambda x: F.xxhash64(x)))).alias("key"))
    best = keyed.groupBy("key").agg(F.max(F.struct("w", "form")).alias("top"))
    near = keyed.join(best, "key").where(F.col("top.w") >= F.greatest(F.col("w") * DOMINANT, F.lit(2)))
    near = near.groupBy("form").agg(F.max("top").alias("top")).select("form", F.col("top.form").alias("canon"), F.col("top.w").alias("cw"))
    canon = every.join(near, "form", "left").select("form", F.coalesce("cw", "w").alias("w"), collapse(F.coalesce("canon", "form")).alias("canon"))
    out = forms.join(canon, "form").groupBy("city", "street", "reading").agg(F.max(F.struct("w", "canon")).alias("c"))
    return out.select("city", "street", "reading", "c.canon", "c.w")


def same_house(df: DataFrame, id_col: str = "rec_id", column: str = "ort_raw") -> DataFrame:
    """``rec_id_a, rec_id_b``: p5_found."""
    # read several times below: parsed once, and the planner needn't unfold the parsing anew each time
    rows = cut(parse(df, id_col, column))
    addresses = rows.groupBy("city", "street", "number", "letter").agg(F.count("*").alias("n"))
    options = cut(resolve(addresses).where(~F.col("canon").isin(*NUMBERED)))
    several = options.groupBy("city", "street").agg((F.count("*") > 1).alias("several"))
    combos = addresses.join(options.join(several, ["city", "street"]), ["city", "street"]).withColumn("key", F.xxhash64("city", "canon", "number", "letter"))
    # any shared hash: what others write in full for the same house
    written = combos.where("not several").groupBy("key").agg(F.sum("n").alias("others"))
    chosen = combos.join(written, "key", "left").groupBy("city", "street", "number", "letter").agg(F.max(F.struct(F.coalesce("others", F.lit(0).cast("long")).alias("others"), "w", "canon")).alias("c"))
    house = chosen.select("city", "street", "number", "letter", F.xxhash64("city", "c.canon", "number", "letter").alias("house"), "c.canon")
    members = rows.join(house, ["city", "street", "number", "letter"]).select("house", F.struct("city", "canon", "number", "letter").alias("at"), "id")
    pairs = split_join(members.select("house", F.col("id").alias("rec_id_a"), F.col("at").alias("at_a")), members.select("house", F.col("id").alias("rec_id_b"), "at"), ["house"])
    # a shared hash must be a shared address
    return pairs.where("rec_id_a < rec_id_b and at_a = at").select("rec_id_a", "rec_id_b")
