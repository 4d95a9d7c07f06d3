"""Short lists of common names, from public census and birth-record frequencies, and the name automaton over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanternsift.functions.spans import SPAN, matches

FIRST = frozenset(
    """aaron adam alice amanda amy andrea andrew angela anna anthony barbara benjamin betty brandon brenda brian carol catherine charles
    christine christopher cynthia daniel david deborah dennis diane donald donna dorothy edward elizabeth emily emma eric evelyn frances frank gary
    george gloria grace gregory heather helen henry jack jacob james janet jason jeffrey jennifer jerry jessica joan john jonathan jose joseph joshua
    joyce judith julia julie justin karen katherine kathleen kelly kenneth kevin kimberly larry laura lauren linda lisa margaret maria marie mark
    martha mary matthew megan melissa michael michelle nancy nathan nicholas nicole olivia pamela patricia patrick paul peter rachel raymond rebecca
    richard robert ronald ruth ryan samantha samuel sandra sara sarah scott sean sharon sophia stephanie stephen steven susan teresa theresa thomas
    timothy tyler victoria virginia walter william zachary jane""".split()
)
LAST = frozenset(
    """adams allen alvarez anderson bailey baker bennett brooks brown campbell carter castillo chavez clark collins cook cooper cox cruz davis diaz
    edwards evans flores foster garcia gomez gonzalez gray green gutierrez hall harris hernandez hill howard hughes jackson jimenez johnson jones
    kelly kim king lee lewis long lopez martin martinez mendoza miller mitchell moore morales morgan morris murphy myers nelson nguyen ortiz parker
    patel perez peterson phillips price ramirez ramos reed reyes richardson rivera roberts robinson rodriguez rogers ross ruiz sanchez sanders scott
    smith stewart taylor thomas thompson torres turner walker ward watson white williams wilson wood wright young doe""".split()
)
TITLES = frozenset("dr miss mr mrs ms mx prof sir".split())
NOT_LAST = frozenset("and at avenue but by city county for from hospital in inc is it llc of on or road street the to university was with".split())
TOKEN = r"[A-Z][.]|[A-Za-z]+(?:'[A-Za-z]+)?|(?U)\d+"
CONFIDENCE = 0.80


def _tree(words: list[str]) -> str:
    """Alternation of sorted words by common first letters: a word start tries a few branches instead of all words."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    return "(?:" + "|".join(h + (_tree(rest) if rest != [""] else "") for h, rest in heads.items() if h) + ("|)" if "" in heads else ")")


GUARD = r"\b" + _tree(sorted(FIRST | TITLES)) + r"\b"


def tokens(text: Column, low: Column) -> Column:
    """Name tokens with places, where a first name or a title occurs at all. low: the text in lower case."""
    return F.when(low.rlike(GUARD), matches(text, TOKEN)).otherwise(F.array().cast("array<struct<start:int,end:int,hit:string>>"))


def _among(c: Column, words: frozenset[str]) -> Column:
    return c.isin(*sorted(words))


def person_names(text: Column, toks: Column) -> Column:
    """Title and name (the title isn't part of it), first name, initial and last name, or first and last name.

    toks must be a column by itself: the fold looks two tokens ahead. A token that a name has used isn't looked at again.
    """
    blank = lambda a, b: F.substring(text, a["end"] + 1, b["start"] - a["end"]).rlike(r"(?U)^\s+$")
    capital = lambda t: t["hit"].rlike("^[A-Z]")
    low = lambda t: F.lower(t["hit"])
    known = lambda t: _among(low(t), FIRST | LAST)
    start = F.struct(F.lit(0).alias("skip"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def found(a: Column, z: Column) -> Column:
        word = F.substring(text, a["start"] + 1, z["end"] - a["start"])
        return F.struct(F.lit("PERSON_NAME").alias("type"), a["start"].alias("start"), z["end"].alias("end"), word.alias("text"), F.lit(CONFIDENCE).alias("confidence"), F.lit("regex/gazetteer").alias("detector"))

    def step(acc: Column, w: Column) -> Column:
        t, n, z = w["t"], w["n"], w["z"]
        bare = F.rtrim(F.regexp_replace(low(t), "[.]$", ""))
        titled = _among(bare, TITLES)
        after_title = titled & n.isNotNull() & capital(n) & known(n)
        full = after_title & z.isNotNull() & capital(z) & _among(low(z), LAST) & blank(n, z)
        first = ~titled & capital(t) & _among(bare, FIRST)
        initial = first & z.isNotNull() & n["hit"].rlike("^[A-Z][.]$") & capital(z) & ~_among(low(z), NOT_LAST | TITLES) & blank(t, n) & blank(n, z)
        pair = first & n.isNotNull() & capital(n) & _among(low(n), LAST) & blank(t, n)
        used = lambda k, span: F.struct(F.lit(k - 1).alias("skip"), F.concat(acc["out"], F.array(span)).alias("out"))
        none = F.struct(F.lit(0).alias("skip"), acc["out"].alias("out"))
        fresh = F.when(F.coalesce(full, F.lit(False)), used(3, found(n, z))).when(F.coalesce(after_title, F.lit(False)), used(2, found(n, n)))
        fresh = fresh.when(F.coalesce(initial, F.lit(False)), used(3, found(t, z))).when(F.coalesce(pair, F.lit(False)), used(2, found(t, n))).otherwise(none)
        return F.when(acc["skip"] > 0, F.struct((acc["skip"] - 1).alias("skip"), acc["out"].alias("out"))).otherwise(fresh)

    ahead = F.transform(toks, lambda t, i: F.struct(t.alias("t"), F.get(toks, i + 1).alias("n"), F.get(toks, i + 2).alias("z")))
    return F.aggregate(ahead, start, step, lambda acc: acc["out"])
