"""Problem 7: variant spellings of names of people and organisations.

1. Every distinct string is parsed to a full key of two parts (surname and given name, or own name and trade, folded to
   lower-case letters without accents, nicknames and abbreviations expanded) or to a short key (surname and initial, or own
   name and acronym). Which words are given names or trades is counted over all strings and joined back to each.
2. The distinct parts are joined by edit distance in a metric space: each part goes to the cell of its nearest pivot and, by
   the triangle inequality, also to every cell whose pivot is at most 2 x RADIUS further; inside a cell the radius join is
   exact: names that share a form with a letter left out are compared by edit distance.
3. A full key points to the most frequent key with one part equal and the other a slip away, else to one with a slip in each
   part; pointers are followed to their end. Keys meet by equality of whole keys, so no surname is a hot group.
4. Short keys join the entity of their initials if there is only one; a surname that fits nobody is tried again through
   surnames a slip away, and short keys that fit nobody point to more frequent short keys a slip away.

Defined results: null, blank and placeholder values name nobody; strings are compared exactly as stored; a short spelling that
fits several people has an entity of its own, shared by equal short keys; repeated rows change nothing but the counts that
choose the most frequent spelling.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, ship, table
from .common import skip_empty

# Results are materialised after a few joins: Spark plans a whole query anew after each of its stages, so the driver's memory
# follows the largest plan, not the rows.

#: Edit distance of parts of keys; two letters in the wrong order are found by equality.
RADIUS = 1
#: Pivots of each space, and names for each if there are few. Typed names are far from each other, so each name is copied to
#: about half of the cells; more pivots would mean more copies.
PIVOTS, PER_PIVOT = 16, 40
#: A slip in each part of a key is looked for in parts of so many letters; a slip in a short key's surname in one more.
MIN_PART = 4

# Nicknames and the names they stand for.
NICKNAMES = {
    "alex": "alexander", "sandy": "alexander", "al": "albert", "andy": "andrew", "toni": "antonia", "tonia": "antonia", "tony": "anthony", "bea": "beatriz", "trixie": "beatriz", "ben": "benjamin", "benny": "benjamin",
    "bill": "william", "billy": "william", "will": "william", "willy": "william", "liam": "william", "bob": "robert", "rob": "robert", "bobby": "robert", "robbie": "robert", "bert": "robert", "charlie": "charlotte", "lottie": "charlotte", "chris": "christina", "tina": "christina", "chrissy": "christina",
    "sasha": "alexander", "kit": "christopher", "dan": "daniel", "dave": "david", "ed": "edward", "eddie": "edward", "ned": "edward", "ted": "edward", "teddy": "edward", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "lizzie": "elizabeth", "eliza": "elizabeth", "lisa": "elizabeth",
    "fran": "francisco", "frank": "francisco", "paco": "francisco", "pancho": "francisco", "fred": "frederick", "freddie": "frederick", "freddy": "frederick", "gabi": "gabriella", "gaby": "gabriella", "gabby": "gabriella", "ella": "gabriella", "beppe": "giuseppe", "peppe": "giuseppe", "pino": "giuseppe",
    "hank": "henrik", "harry": "henry", "jackie": "jacqueline", "jim": "james", "jimmy": "james", "joe": "joseph", "joey": "joseph", "hans": "johannes", "jan": "johannes", "hannes": "johannes", "jon": "jonathan", "jack": "john", "johnny": "john", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kat": "katherine", "kitty": "katherine", "cathy": "catherine",
    "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "greta": "margaret", "max": "maximilian", "mike": "michael", "mick": "michael", "mickey": "michael", "mitch": "michael", "nick": "nicholas", "nicky": "nicholas", "klaus": "nicholas", "pat": "patrick", "paddy": "patrick", "pete": "peter", "rich": "richard", "rick": "richard", "dick": "richard",
    "sam": "samuel", "sammy": "samuel", "steve": "stephen", "sue": "susanna", "susie": "susanna", "suzy": "susanna", "susan": "susanna", "anna": "susanna", "sanna": "susanna", "theo": "theodore", "tom": "thomas", "tommy": "thomas", "vicky": "victoria", "vicki": "victoria", "tori": "victoria", "vic": "victoria",
}
# What a nickname can also stand for.
ALSO = {"ted": ["theodore"], "teddy": ["theodore"], "joe": ["giuseppe", "johannes"], "chris": ["christopher"], "jack": ["jacqueline"], "alex": ["alexandra"], "sam": ["samantha"], "pat": ["patricia"], "tom": ["tomas"], "frank": ["franklin"], "bert": ["albert"]}
# Words before and after a person's name.
TITLES = frozenset("dr prof professor capt captain cpt mr mrs ms miss sir ing eng dipl phd msc bsc ir drs ch chief mate jr sr md".split())
# Words that name nobody.
PLACEHOLDERS = frozenset("admin administrator user unknown anonymous none null nil guest scanner test author owner root system document control station front desk office scan default n/a na tbd tbc unnamed editor staff".split())
# Legal forms, without points.
LEGAL = frozenset("gmbh mbh ag kg bv nv as asa aps oy ab sa sas sarl srl spa sl ltd limited plc llc llp inc incorporated corp corporation co pte pty".split())
# Abbreviations of words in names of organisations.
SHORT_WORDS = {
    "nav": "naval", "arch": "architects", "mar": "marine", "marit": "maritime", "inst": "institute", "svcs": "services", "svc": "services", "serv": "services", "mgmt": "management", "mgt": "management", "shpg": "shipping", "shp": "shipping", "offsh": "offshore", "eng": "engineering", "engg": "engineering",
    "wks": "works", "intl": "international", "int": "international", "drlg": "drilling", "drill": "drilling", "class": "classification", "reg": "register", "auth": "authority", "univ": "university", "dept": "department", "assn": "association", "assoc": "association", "tech": "technology", "res": "research", "lab": "laboratory", "bros": "brothers", "grp": "group", "hldgs": "holdings", "tow": "towage", "salv": "salvage", "dies": "diesel", "prt": "port", "cntr": "center", "natl": "national", "ind": "industries", "mfg": "manufacturing", "sys": "systems", "co": "company",
}
_TRADES = frozenset(SHORT_WORDS.values())
_SMALL = frozenset("the of and for de des du der di da e y et und & m s".split())


def fold(s: str) -> str:
    """Lower case without accents."""
    s = s.lower().replace("ß", "ss").replace("ø", "o").replace("æ", "ae").replace("œ", "oe").replace("ł", "l").replace("đ", "d")
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def person_tokens(value: str) -> tuple[list[str], list[str] | None] | None:
    """(tokens before a comma or all, tokens after the comma), or None if the value names nobody."""
    s = re.sub(r"(?i)\bet\s+al\.?\s*$", "", value.strip())
    parts = [fold(p) for p in s.split(",", 1)]
    out = []
    for p in parts:
        out.append([t for t in re.split(r"[^\w'-]+", p) if t and t not in TITLES])
    words = [t for p in out for t in p]
    if not words or all(t in PLACEHOLDERS or t.isdigit() or len(t) < 2 for t in words) or fold(s).strip() in PLACEHOLDERS or any(t.isdigit() for t in words):
        return None
    if sum(t in PLACEHOLDERS for t in words) >= max(1, len(words) - 1):
        return None
    return out[0], (out[1] if len(out) > 1 and out[1] else None)


def _initials(t: str) -> bool:
    return len(t) == 1


def parse_person(value: str, given_names: frozenset[str] | set[str]) -> tuple[str, str, str, str] | None:
    """(surname, given name or empty, its initial, middle initials)."""
    tokens = person_tokens(value)
    if tokens is None:
        return None
    first, after = tokens
    if after is not None:
        surname, given = " ".join(t for t in first if len(t) > 1) or " ".join(first), after
    else:
        long = [t for t in first if len(t) > 1]
        if not long:
            return None
        if len(first) > 1 and len(first[-1]) == 2 and len(first) == 2 and first[-1].upper() in value:  # Last FM
            return (first[0], "", first[-1][0], first[-1][1:])
        if len(long) == 1:
            surname = long[0]
            given = [t for t in first if t != surname]
        elif len(long) == 2 and long[0] not in given_names and long[1] in given_names:
            surname = long[0]
            given = [t for t in first if t != surname]
        else:
            surname = long[-1] if len(first[-1]) > 1 else long[0]
            at = first.index(surname) if surname == long[0] else len(first) - 1 - first[::-1].index(surname)
            given = first[:at] + first[at + 1 :]
    if not given:
        return (surname, "", "", "")
    if len(given) == 1 and len(given[0]) == 2 and given[0] not in given_names and given[0].upper() in value:
        return (surname, "", given[0][0], given[0][1:])
    name = given[0]
    middle = "".join(t[0] for t in given[1:])
    if name in ALSO:
        return (surname, "", "~" + name, middle)
    return (surname, "" if _initials(name) else NICKNAMES.get(name, name), name[0], middle)


def _options(initial: str) -> list[str] | None:
    """The names that a nickname of several meanings can stand for; of initials none."""
    return [NICKNAMES[initial[1:]], *ALSO[initial[1:]]] if initial.startswith("~") else None


def organisation_words(value: str, trades: frozenset[str] | set[str] = _TRADES) -> list[tuple[str, str]]:
    """(folded word, as written), legal forms and articles left out; "co" directly after a trade is a company, else a legal form."""
    s = re.sub(r"(?i)^\s*m/s\b\.?", " ", value)
    s = re.sub(r"(?i)\bA/S\b", "AS", s)
    s = re.sub(r"\b((?:\w\.){2,})", lambda m: m.group().replace(".", ""), s)
    out = []
    trade_end = -1  # where the last word ends, if it is a trade
    for m in re.finditer(r"[\w']+(?:&[\w']+)?", s):
        w = m.group()
        low = fold(w)
        after_trade = trade_end >= 0 and "&" not in s[trade_end : m.start()]
        trade_end = m.end() if SHORT_WORDS.get(low, low) in trades and low not in LEGAL else -1
        if low == "co" and after_trade:
            out.append((SHORT_WORDS[low], low))
            continue
        if (low in LEGAL or low in _SMALL) and not (_acronym(w) and low not in LEGAL and not value.isupper()):
            continue
        out.append((SHORT_WORDS.get(low, low), w))
    return out


def _acronym(written: str) -> bool:
    letters = written.replace("&", "")
    return 1 < len(letters) <= 4 and letters.isupper()


def parse_organisation(value: str, trades: frozenset[str] | set[str]) -> tuple[str, str, str, str] | None:
    """(own name, trade words in order or empty, acronym, empty)."""
    words = organisation_words(value, trades)
    if not words or all(w in PLACEHOLDERS for w, _ in words):
        return None
    shorts = [] if value.isupper() else [x for x in words if _acronym(x[1])]
    own = [w for w, written in words if w not in trades or (w, written) in shorts]
    trade = [w for w, written in words if w in trades and (w, written) not in shorts]
    if not trade and len(words) > 1 and len(shorts) == 1 and len(words) - 1 == len(own) - 1 and not value.isupper():
        acronym = shorts[0][0].replace("&", "")
        return (" ".join(w for w in own if w != shorts[0][0]), "", acronym, "")
    if not own:
        return (" ".join(trade), "", "", "")
    return (" ".join(own), " ".join(trade), "".join(w[0] for w in trade), "")


def _all_words(value: str) -> list[str]:
    """Every word of an organisation's name that could be a trade, abbreviations expanded."""
    return [SHORT_WORDS.get(w, w) for w in (fold(m) for m in re.findall(r"[\w']+(?:&[\w']+)?", re.sub(r"\b((?:\w\.){2,})", lambda m: m.group().replace(".", ""), value)))]


def _tokenised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Strings with all their tokens, and those in the place of a given name or trade (second) or of a surname or own name (first)."""
    for pdf in batches:
        rows = []
        for field, value, n in zip(pdf.field_name, pdf.value, pdf.n):
            if field == "author":
                tokens = person_tokens(value)
                if tokens is None:
                    continue
                first, after = tokens
                if after is not None:
                    given, sur = [t for t in after if len(t) > 2], [t for t in first if len(t) > 2]
                elif len(first) > 1:
                    given, sur = [t for t in first[:1] if len(t) > 2], [t for t in first[-1:] if len(t) > 2]
                else:
                    given, sur = [], []
                every = first + (after or [])
            else:
                words = [w for w, written in organisation_words(value) if value.isupper() or not _acronym(written)]
                given, sur, every = words[1:], words[:1], _all_words(value)
            rows.append((field, value, n, list(dict.fromkeys(every)), given, sur))
        yield pd.DataFrame(rows, columns=["field_name", "value", "n", "tokens", "second", "first"])


def parsed(values: DataFrame) -> DataFrame:
    """values(field_name, value, n) with base, detail, initial, middle of each string that names somebody."""
    tokens = cut(values.mapInPandas(skip_empty(_tokenised), "field_name string, value string, n bigint, tokens array<string>, second array<string>, first array<string>"))
    places = tokens.select("field_name", F.explode("second").alias("token"), F.lit(1).alias("second")).unionByName(tokens.select("field_name", F.explode("first").alias("token"), F.lit(0).alias("second")))
    roles = places.groupBy("field_name", "token").agg(F.sum("second").alias("second"), F.sum(1 - F.col("second")).alias("own"))
    known = roles.where(((F.col("field_name") == "author") & (F.col("second") > F.col("own"))) | ((F.col("field_name") != "author") & (F.col("second") >= 3) & (F.col("second") > 2 * F.col("own"))))
    hits = tokens.select("field_name", "value", F.explode("tokens").alias("token")).join(known.select("field_name", "token"), ["field_name", "token"])
    hits = hits.groupBy("field_name", "value").agg(F.collect_set("token").alias("known"))  # at most the words of one string
    always = {"author": frozenset(NICKNAMES.values()) | frozenset(NICKNAMES), "organization": _TRADES}

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for field, value, n, own in zip(pdf.field_name, pdf.value, pdf.n, pdf.known):
                words = always[field].union(own) if own is not None else always[field]
                out = parse_person(value, words) if field == "author" else parse_organisation(value, words)
                if out and out[0]:
                    rows.append((field, value, n, *out))
            yield pd.DataFrame(rows, columns=["field_name", "value", "n", "base", "detail", "initial", "middle"])

    both = tokens.select("field_name", "value", "n").join(hits, ["field_name", "value"], "left")
    return both.mapInPandas(skip_empty(parse), "field_name string, value string, n bigint, base string, detail string, initial string, middle string")


def radius_pairs(keys: DataFrame, radius: int = RADIUS, pivots: int = PIVOTS) -> DataFrame:
    """All pairs (space, a, b, distance) with a < b and edit distance up to radius of keys(space, key), which are distinct.

    Inside a cell only names that share a form with up to radius letters left out are compared (names within radius always
    do), so the work grows with the number of names and a large cell is no task of its own."""
    spark = keys.sparkSession
    rows = []
    for space, n in {r.space: r.n for r in keys.groupBy("space").agg(F.count("*").alias("n")).collect()}.items():  # one row a field and part
        count = max(1, min(pivots, n // PER_PIVOT))
        rows.append((space, [r.key for r in keys.where(F.col("space") == space).orderBy(F.xxhash64("key"), "key").limit(count).collect()]))
    if not rows:
        return spark.createDataFrame([], "space string, a string, b string, distance int")
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work: by number, so it is not coalesced
    far = keys.repartition(tasks, "key").join(F.broadcast(spark.createDataFrame(rows, "space string, pivots array<string>")), "space")
    far = far.withColumn("far", F.expr("transform(pivots, p -> levenshtein(key, p))")).withColumn("least", F.array_min("far")).withColumn("home", F.array_position("far", F.col("least")).cast("int") - 1)
    forms = "array(key)"
    for _ in range(radius):
        forms = f"array_distinct(concat({forms}, flatten(transform({forms}, f -> transform(sequence(1, greatest(length(f), 1)), i -> concat(left(f, i - 1), substr(f, i + 1)))))))"
    # one row a key, materialised: both sides of the join below read it, and each would hold its plan
    cells = cut(far.select("space", "key", "home", F.expr(f"filter(sequence(0, size(far) - 1), i -> far[i] <= least + {2 * radius})").alias("cells")))
    cells = cells.select("space", "key", "home", F.expr(f"transform({forms}, f -> xxhash64(f))").alias("forms"), F.explode("cells").alias("cell"))
    cells = cells.select("space", "cell", F.explode("forms").alias("form"), "key", (F.col("home") == F.col("cell")).alias("home"))
    x, y = cells.where("home").select("space", "cell", "form", F.col("key").alias("x")), cells.select("space", "cell", "form", F.col("key").alias("y"))
    near = x.join(y, ["space", "cell", "form"]).where(F.col("x") != F.col("y")).select("space", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return near.withColumn("distance", F.expr(f"levenshtein(a, b, {radius})")).where(F.col("distance") >= 0)


def swapped_pairs(keys: DataFrame) -> DataFrame:
    """Pairs (space, a, b) with a < b of keys(space, key) that differ by two neighbouring letters in the other order."""
    other = F.expr("explode(transform(sequence(1, greatest(length(key) - 1, 1)), i -> concat(left(key, i - 1), substr(key, i + 1, 1), substr(key, i, 1), substr(key, i + 2))))")
    return keys.select("space", F.col("key").alias("a"), other.alias("key")).where(F.col("a") < F.col("key")).distinct().join(keys, ["space", "key"]).select("space", "a", F.col("key").alias("b"))


def _follow(pointers: DataFrame) -> DataFrame:
    """(space, key, root) from (space, key, target): pointers are doubled until they end; they have no cycles."""
    current = cut(pointers.select("space", "key", F.col("target").alias("root")))  # each step reads it twice
    while True:
        step = current.alias("p").join(current.select("space", F.col("key").alias("root"), F.col("root").alias("next")), ["space", "root"], "left")
        nxt = cut(step.select("space", "key", F.coalesce("next", "root").alias("new"), "root"))
        moved = not nxt.where(F.col("new") != F.col("root")).isEmpty()
        current = nxt.select("space", "key", F.col("new").alias("root"))
        if not moved:
            return current


def _pointed(weights: DataFrame, edges: DataFrame) -> DataFrame:
    """(space, key, root) of weights(space, key, n) by edges(space, key, other, one): to the more frequent other, one slip before two."""
    both = edges.join(weights, ["space", "key"]).join(weights.select("space", F.col("key").alias("other"), F.col("n").alias("other_n")), ["space", "other"])
    better = both.where((F.col("other_n") > F.col("n")) | ((F.col("other_n") == F.col("n")) & (F.col("other") < F.col("key"))))
    target = better.groupBy("space", "key").agg(F.max_by("other", F.struct("one", "other_n", "other")).alias("target"))
    return _follow(weights.select("space", "key").join(target, ["space", "key"], "left").withColumn("target", F.coalesce("target", "key")))


def neighbours(names: DataFrame) -> DataFrame:
    """(space, place, part, other, distance) in both directions: parts of keys a slip apart, or two letters swapped (distance 2)."""
    spaces = F.array(F.struct(F.lit("b").alias("place"), F.col("base").alias("key")), F.struct(F.lit("d").alias("place"), F.col("detail").alias("key")))
    parts = names.where((F.col("detail") != "") | (F.col("initial") != "")).select("field_name", F.explode(spaces).alias("p")).where(F.col("p.key") != "")
    parts = parts.select(F.concat_ws("/", "field_name", "p.place").alias("space"), "p.key").distinct()
    parts = cut(parts)
    pairs = radius_pairs(parts).unionByName(swapped_pairs(parts).withColumn("distance", F.lit(2)))
    both = F.array(F.struct(F.col("a").alias("part"), F.col("b").alias("other")), F.struct(F.col("b").alias("part"), F.col("a").alias("other")))
    out = pairs.select("space", "distance", F.explode(both).alias("p"))
    return cut(out.select(F.split_part("space", F.lit("/"), F.lit(1)).alias("space"), F.split_part("space", F.lit("/"), F.lit(2)).alias("place"), "p.part", "p.other", "distance"))


def key_edges(keys: DataFrame, near: DataFrame) -> DataFrame:
    """(space, key, other, one) between keys(space, key, base, detail); other need not be a key."""
    def of(place: str, part: str) -> DataFrame:
        return near.where(F.col("place") == place).select("space", F.col("part").alias(part), F.col("other").alias(f"{part}_2"), F.col("distance").alias(f"{part}_distance"))

    bases, details = of("b", "base"), of("d", "detail")
    by_base = cut(keys.join(bases, ["space", "base"]))
    one = by_base.select("space", "key", F.concat_ws("|", "base_2", "detail").alias("other")).unionByName(keys.join(details, ["space", "detail"]).select("space", "key", F.concat_ws("|", "base", "detail_2").alias("other")))
    long = lambda c: (F.length(c) >= MIN_PART) & (F.length(f"{c}_2") >= MIN_PART) & (F.col(f"{c}_distance") == 1)
    two = by_base.where(long("base")).join(details.where(long("detail")), ["space", "detail"]).select("space", "key", F.concat_ws("|", "base_2", "detail_2").alias("other"))
    return cut(one.withColumn("one", F.lit(True)).unionByName(two.withColumn("one", F.lit(False))))


def fitting(short: DataFrame, heads: DataFrame) -> DataFrame:
    """short(field_name, base, initial, middle, look) with n_fit, root, n_sure, sure: the entities that a short key fits.

    look is the surname to look under. heads(field_name, base, detail, root, middles) are summed by surname and initial, or
    name, before they meet the short keys: a surname with many people is one row for each initial."""
    acronym = F.when(F.col("field_name") == "author", F.left("detail", F.lit(1))).otherwise(F.expr("array_join(transform(split(detail, ' '), w -> left(w, 1)), '')"))
    tagged = heads.withColumn("tag", F.explode(F.array(acronym, F.concat(F.lit("="), F.col("detail")))))
    bare = F.size("middles") == 0
    group = ["field_name", "base", "tag"]
    alone = tagged.groupBy(*group).agg(F.count("*").alias("n_all"), F.max("root").alias("r_all"), F.count_if(bare).alias("n_bare"), F.max(F.when(bare, F.col("root"))).alias("r_bare"))
    lettered = tagged.withColumn("m", F.explode(F.array_distinct(F.transform("middles", lambda x: F.left(x, F.lit(1)))))).groupBy(*group, "m").agg(F.count("*").alias("n_letter"), F.max("root").alias("r_letter"))
    meanings = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for k in ALSO for x in ("~" + k, ["=" + o for o in _options("~" + k)])])
    tags = F.when(F.col("initial").startswith("~"), F.try_element_at(meanings, F.col("initial"))).otherwise(F.array("initial"))
    asked = short.withColumn("tag", F.explode(tags)).withColumn("m", F.left("middle", F.lit(1)))
    met = asked.join(alone.withColumnRenamed("base", "look"), ["field_name", "look", "tag"]).join(lettered.withColumnRenamed("base", "look"), ["field_name", "look", "tag", "m"], "left")
    has = F.col("m") != ""
    letter = F.coalesce("n_letter", F.lit(0))
    met = met.select(
        *[c for c in short.columns if c != "look"], F.when(has, F.col("n_bare") + letter).otherwise(F.col("n_all")).alias("n"), F.when(has, F.coalesce("r_letter", "r_bare")).otherwise(F.col("r_all")).alias("r"),
        F.when(has, letter).otherwise(F.lit(0)).alias("ns"), F.when(has, F.col("r_letter")).alias("rs"),
    )
    return met.groupBy(*[c for c in short.columns if c != "look"]).agg(F.sum("n").alias("n_fit"), F.max(F.when(F.col("n") > 0, F.col("r"))).alias("root"), F.sum("ns").alias("n_sure"), F.max("rs").alias("sure"))


def linked(values: DataFrame, ambiguous: bool = False) -> DataFrame:
    """(field_name, value, entity) of every string of values(field_name, value, n) that names somebody.

    ambiguous: also short spellings that fit several entities, as entities of their own."""
    ship(values.sparkSession)
    names = cut(parsed(values))
    near = neighbours(names)
    full = names.where(F.col("detail") != "").withColumn("key", F.concat_ws("|", "base", "detail"))
    keys = cut(full.groupBy(F.col("field_name").alias("space"), "key", "base", "detail").agg(F.sum("n").alias("n")))
    roots = _pointed(keys.select("space", "key", "n"), key_edges(keys, near))
    whole = cut(full.join(roots.select(F.col("space").alias("field_name"), "key", "root"), ["field_name", "key"]))
    heads = whole.groupBy("field_name", "root").agg(F.collect_set(F.nullif("middle", F.lit(""))).alias("middles"))
    heads = cut(heads.withColumns({"base": F.split_part("root", F.lit("|"), F.lit(1)), "detail": F.split_part("root", F.lit("|"), F.lit(2))}))
    # initials, and nicknames that stand for several names: the entity must be the only one that they fit
    spelled = names.where((F.col("detail") == "") & (F.col("initial") != ""))
    own = ["field_name", "base", "initial", "middle"]
    short = cut(spelled.groupBy(*own).agg(F.sum("n").alias("n")))
    beside = near.where((F.col("place") == "b") & (F.length("part") > MIN_PART) & (F.length("other") > MIN_PART)).select(F.col("space").alias("field_name"), F.col("part").alias("base"), F.col("other").alias("look"))
    asked = short.select(*own, F.col("base").alias("look"), F.lit(1).alias("exact")).unionByName(short.select(*own).join(beside, ["field_name", "base"]).withColumn("exact", F.lit(0)))
    fits = fitting(cut(asked), heads).where(F.col("n_fit") > 0)
    fits = fits.groupBy(*own).agg(F.max_by(F.struct("n_fit", "root", "n_sure", "sure"), "exact").alias("f")).select(*own, "f.*")  # surnames as written go first
    entity = F.when(F.col("n_fit") == 1, F.col("root")).when(F.col("n_sure") == 1, F.col("sure"))
    found = cut(fits.select(*own, entity.alias("entity")))
    # short keys that fit nobody: equal surnames and initials are one, and point to more frequent ones a slip away
    nobody = cut(short.join(found.select(*own), own, "left_anti").withColumn("key", F.concat_ws("|", "base", "initial")))
    single = cut(nobody.groupBy(F.col("field_name").alias("space"), "key", "base", "initial").agg(F.sum("n").alias("n")))
    steps = single.join(beside.withColumnRenamed("field_name", "space"), ["space", "base"]).select("space", "key", F.concat_ws("|", "look", "initial").alias("other"), F.lit(True).alias("one"))
    alone = _pointed(single.select("space", "key", "n"), steps).select(F.col("space").alias("field_name"), "key", F.concat_ws("|", F.lit("short"), "root").alias("entity"))
    chosen = cut(found.select(*own, "entity").unionByName(nobody.join(alone, ["field_name", "key"]).select(*own, "entity")))
    if ambiguous:
        chosen = chosen.withColumn("entity", F.coalesce("entity", F.concat_ws("|", F.lit("short"), "base", "initial", "middle")))
    shorts = spelled.select("value", *own).join(chosen.where(F.col("entity").isNotNull()), own).select("field_name", "value", "entity")
    sole = names.where((F.col("detail") == "") & (F.col("initial") == "")).select("field_name", "value", F.concat_ws("|", F.lit("sole"), "base").alias("entity"))
    return whole.select("field_name", "value", F.col("root").alias("entity")).unionByName(shorts).unionByName(sole)


def name_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = table(spark, sf_dir, "documents_state")
    both = state.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"merged.{f}.value").alias("value")) for f in ("author", "organization")])).alias("v")).select("v.*")
    return both.where(F.regexp_like("value", F.lit(r"\p{L}"))).groupBy("field_name", "value").agg(F.count("*").alias("n"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cut(linked(name_values(spark, sf_dir), ambiguous=True))
    a, b = out.select("field_name", "entity", F.col("value").alias("value_a")), out.select("field_name", "entity", F.col("value").alias("value_b"))
    return a.join(b, ["field_name", "entity"]).where(F.col("value_a") < F.col("value_b")).select("field_name", "value_a", "value_b").distinct()


def p7_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per string with its entity and the entity's number of spellings (counted before the join, so no entity is one task)."""
    out = cut(linked(name_values(spark, sf_dir), ambiguous=True))
    return out.join(out.groupBy("field_name", "entity").agg(F.count("*").alias("n_spellings")), ["field_name", "entity"])


QUERIES = {"p7_found": p7_found, "p7_entities": p7_entities}
