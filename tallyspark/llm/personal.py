"""Personal data in texts by weak supervision, in DataFrame functions only.

Four kinds have exact rules ("base"): email, ip, card, phone. Further kinds only have shapes that innocent texts share, so a
shape makes a candidate and LABELERS vote on it, for (1), against (-1) or not at all (0): its form (checksums, valid
ranges), gazetteers (given names, country codes), the words before it, the words after it, personal data in the same text, and how
it stands on its line. Expectation-maximisation over the counts of vote patterns estimates how often each labeler is right and
how common each kind is; the posteriors then train a logistic classifier over votes, kind and shape, which
decides. A candidate for which none of the labelers votes that look at it or the words beside it is never taken, and
what a base span covers is no candidate.

Everything about a text stays in its row: one scan finds spans and votes, vote patterns are counted by groupBy, and the
classifier is applied to the saved candidates. The tables that are iterated over have as many rows as there are patterns, and
the driver sees one number for each feature.

Defined cases: null texts count as empty and have no spans; a null id stays; repeated rows get equal results and
count once each in the patterns; an empty table gives no rows, and without candidates nothing is learned or added;
of overlapping shapes the leftmost counts, at one place the first in SHAPES; patterns are written without backtracking over
long runs, so very long texts take linear time; other columns play no part, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import quoted, scratch

#: Base patterns. Where a kind's first characters may repeat, a match starts at the first of them or where the last match
#: ended; what follows them is the same for all, so no other start can match. Possessive repeats never need to give back.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
BASE = ("email", "ip", "card", "phone")

#: Candidate shapes, by kind; none starts within a run that it could have started with.
SHAPES = {
    "spelled_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]\x20?(?:at|AT|ät)\x20?[\])]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|[\[(]\x20?(?:dot|DOT|punkt)\x20?[\])])\x20?[A-Za-z0-9-]{1,63}+){1,8}+",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9A-Za-z+(./-])(?:\([0-9]{2,5}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z/-])",
    "birth_date": r"(?<![0-9./-])(?:[0-9]{1,2}([./-])[0-9]{1,2}\1(?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9/-])",
    "address": r"(?<![0-9.,])[0-9]{1,5}\x20(?:[A-Z][a-z]{1,20}+\x20){1,3}?(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Place|Pl|Square|Sq|Terrace|Way)(?![A-Za-z])",
    "name": r"(?=\p{Lu})(?<![\p{L}\p{N}'.-])(?:(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señora?|Sra?)\.?\x20)?\p{Lu}\p{Ll}{1,20}+(?:\x20\p{Lu}\.)?(?:\x20\p{Lu}[\p{L}'-]{1,30}+){1,2}",
}
KINDS = (*BASE, *SHAPES)
#: All shapes at once; the mark that a date repeats has the only group. Without a digit or a spelled "at" only names can be found.
CANDIDATE = "|".join(SHAPES.values())
MORE_THAN_NAMES = r"[0-9]|[\[(]\x20?(?:at|AT|ät)"

#: Gazetteers and cue words.
GIVEN = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Mark Donald Steven Paul Andrew Joshua Kenneth Kevin Brian George Edward Ronald Timothy Jason Jeffrey Ryan Jacob Gary "
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Betty Margaret Sandra Ashley Kimberly Emily Donna Michelle Carol Amanda Dorothy Melissa Deborah Stephanie Rebecca Sharon Laura Cynthia Kathleen Amy Anna Alice Emma Olivia Sophia Jane "
    "Hans Klaus Jürgen Peter Wolfgang Michael Stefan Andreas Ursula Monika Petra Sabine Renate Claudia Jean Pierre Michel André Philippe Nathalie Isabelle Sylvie Catherine Marie Antonio José Manuel Francisco Juan Carmen María Ana Isabel Dolores Luis Carlos Pablo"
).split()
COMMON = "The This That These Those There When Where What Who How And But For From With Without After Before In On At By Of To As If It Its We You He She They Our Your His Her Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April June July August September October November December New North South East West United University Street Road Avenue Company License Licensed General Public Version Apache Foundation Software Copyright Inc Ltd Corporation".split()
COUNTRIES = "AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM".split()
DOMAINS = "com org net edu gov io co de fr es it uk us eu info".split()
OWN = {
    "spelled_email": r"\b(?:e-?mail|mail|contact|write|reach|kontakt|contacto|courriel)\b",
    "national_id": r"\b(?:ssn|social security|tax id|national id|taxpayer)\b",
    "iban": r"\b(?:iban|account|konto|compte|cuenta|transfer|bank)\b",
    "local_phone": r"\b(?:tel|phone|call|mobile|cell|fax|telefon|téléphone|teléfono|contact)\b",
    "birth_date": r"\b(?:born|birth|dob|birthday|geboren|geburtsdatum|née?|naissance|nacid[oa]|nacimiento)\b",
    "address": r"\b(?:address|lives? at|living at|resid\w+|home|adresse|wohnhaft|ship to|deliver)\b",
    "name": r"\b(?:name|contact|signed|regards|sincerely|patient|customer|client|called|dear|hello|hi|mr|mrs|ms|dr)\b",
}
FOREIGN = r"\b(?:isbn|issn|version|order|invoice|figure|fig|table|page|section|chapter|serial|part no|model|released|published|updated|ticket|build|total|sum)\b"
COUNTED = r"^\s?(?:%|€|\$|£|(?:kg|km|cm|mm|mb|gb|units?|pieces?|pages?|items?|rows?|points?)\b)"
SAID = r"^,?\s(?:said|says|born|lives|lived|wrote|writes|aged?|who|and (?:his|her)|\(born)\b"
PLACE = r"^,?\s\p{Lu}[\p{L} ]{1,30}(?:,?\s[A-Z]{2}\s[0-9]{5}|,?\s[0-9]{4,5})"

#: The first OWN_VOTES look at the span and the words beside it; the others only at where it stands.
LABELERS = ("form", "gazetteer", "before", "after", "company", "line")
OWN_VOTES = 4
VOTES = 3 * len(LABELERS)
CHUNK, BEFORE, AFTER, ROUNDS = 128, 48, 32, 40
SPAN = "array<struct<text:string,start:int,end:int,before:string,after:string>>"


def located(text: Column, pattern: str, contexts: bool = False) -> Column:
    """The matches of pattern from left to right as (text, start, end, before, after), in characters, `end` exclusive; before and
    after reach to the next match at most and are null unless asked for. Places are running sums of lengths: within chunks of CHUNK matches, then over chunks."""

    def spans(both):
        hits, gaps = both["hits"], both["gaps"]
        near = lambda i, size: F.substring(gaps[i], F.lit(-size), F.lit(size)) if contexts else F.lit(None).cast("string")
        parts = F.transform(hits, lambda h, i: F.struct(h.alias("text"), F.length(gaps[i]).alias("gap"), F.length(h).alias("size"), near(i, BEFORE).alias("before"), (F.substring(gaps[i + 1], 1, AFTER) if contexts else F.lit(None).cast("string")).alias("after")))

        def placed(chunk, at):
            step = lambda s, x: F.struct(
                (s["at"] + x["gap"] + x["size"]).alias("at"),
                F.concat(s["out"], F.array(F.struct(x["text"].alias("text"), (s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + x["size"]).alias("end"), x["before"].alias("before"), x["after"].alias("after")))).alias("out"),
            )
            return F.aggregate(chunk, F.struct(at.cast("int").alias("at"), F.array().cast(SPAN).alias("out")), step, lambda s: s["out"])

        def by_chunks(parts):
            chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / CHUNK).cast("int")), lambda c: F.slice(parts, c * CHUNK + 1, F.lit(CHUNK)))
            sizes = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x["gap"] + x["size"]))
            starts = F.aggregate(sizes, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
            return let(F.struct(chunks.alias("chunks"), starts.alias("starts")), lambda v: F.flatten(F.transform(v["chunks"], lambda c, i: placed(c, v["starts"][i]))))

        return let(parts, lambda p: F.when(F.size(p) <= CHUNK, placed(p, F.lit(0))).otherwise(by_chunks(p)))

    some = lambda hits: let(F.struct(hits.alias("hits"), F.split(text, pattern, -1).alias("gaps")), spans)
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) == 0, F.array().cast(SPAN)).otherwise(some(hits)))


def hidden(text: Column, pattern: str, good) -> Column:
    """text with each match of pattern that is good overwritten, so that places stay."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))
    cover = lambda h: F.when(good(h), F.repeat(F.lit("\uFFFC"), F.length(h))).otherwise(h)
    return let(both, lambda v: F.array_join(F.transform(v["gaps"], lambda g, i: F.concat(g, F.coalesce(cover(F.get(v["hits"], i)), F.lit("")))), ""))


def luhn(digits: Column) -> Column:
    """Whether the check digit fits."""
    n = F.length(digits)

    def worth(i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), worth), F.lit(0), lambda s, x: s + x) % 10 == 0


def bare(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


#: For each base kind its pattern, a cheap test that goes ahead of it, and what a match must be.
RULES = {
    "email": (EMAIL, lambda t: t.contains("@"), lambda h: h.isNotNull()),
    "ip": (IP, lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), lambda h: h.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")),
    "card": (CARD, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), lambda h: F.when(F.length(bare(h)).between(13, 19), let(bare(h), luhn)).otherwise(False)),
    "phone": (PHONE, lambda t: t.rlike(r"\+[0-9]"), lambda h: F.length(bare(h)).between(9, 15)),
}


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each base kind."""

    def found(pattern, test, good):
        return F.when(test(text), F.filter(located(text, pattern), lambda s: good(s["text"]))).otherwise(F.array().cast(SPAN))

    return {kind: found(*rule) for kind, rule in RULES.items()}


def kind_of(shape: Column) -> Column:
    """The first kind whose shape a candidate has."""
    return F.coalesce(*[F.when(shape.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in enumerate(SHAPES.values())])


def rests(iban: Column) -> Column:
    """An IBAN's remainder by 97."""
    bare = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda s, c: let(value(c), lambda v: (s * F.when(v > 9, 100).otherwise(10) + v) % 97))


def votes_of(kind: Column, c: Column, company: Column) -> list[Column]:
    """What each labeler says of candidate c: 1, 0 or -1."""
    text, before, after = c["text"], F.lower(c["before"]), F.lower(c["after"])
    names = list(SHAPES)
    digits = bare(text)
    says = lambda yes, no=None: F.when(yes, 1).otherwise(F.lit(0) if no is None else F.when(no, -1).otherwise(0))
    by_kind = lambda votes: F.coalesce(*[F.when(kind == names.index(k), v) for k, v in votes.items()], F.lit(0))
    years = F.regexp_extract(text, "(?:19|20)[0-9]{2}", 0).cast("int")
    day_month = F.regexp_extract_all(F.regexp_replace(text, "(?:19|20)[0-9]{2}", ""), F.lit("[0-9]{1,2}"), F.lit(0))
    dated = F.array_max(F.transform(day_month, lambda x: x.cast("int"))).between(1, 31) & F.array_min(F.transform(day_month, lambda x: x.cast("int"))).between(1, 12)
    words = F.split(F.regexp_replace(text, r"^(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señora?|Sra?)\.?\x20", ""), " ")
    titled = text.rlike(r"^(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señora?|Sra?)\.?\x20")
    form = by_kind({
        "spelled_email": says(text.rlike(r"[A-Za-z]{2,}$"), ~text.rlike(r"[A-Za-z]{2,}$")),
        "national_id": says(~text.rlike(r"^(?:000|666|9)|-00-|-0000$"), text.rlike(r"^(?:000|666|9)|-00-|-0000$")),
        "iban": F.when(rests(text) == 1, 1).otherwise(-1),
        "local_phone": says(F.length(digits).between(10, 11) & digits.rlike("^0?[2-9]"), F.length(digits) < 9),
        "birth_date": says(F.lit(False), ~(dated & years.between(1900, 2020))),
        "address": says(~text.startswith("0"), text.startswith("0")),
        "name": says(titled),
    })
    gazetteer = by_kind({
        "spelled_email": says(F.lower(F.regexp_extract(text, "[A-Za-z]+$", 0)).isin(DOMAINS)),
        "iban": says(F.substring(text, 1, 2).isin(COUNTRIES), ~F.substring(text, 1, 2).isin(COUNTRIES)),
        "local_phone": says(F.lit(False), digits.rlike(r"^(?:800|888|877|866|900|555|123456)|^(.)\1+$")),
        "national_id": says(F.lit(False), digits.rlike(r"^(?:078051120|219099999|123456789)$|^(.)\1+$")),
        "name": says(words[0].isin(GIVEN), F.arrays_overlap(words, F.array(*map(F.lit, COMMON)))),
    })
    cue = F.coalesce(*[F.when(kind == names.index(k), before.rlike(p)) for k, p in OWN.items()])
    ahead = F.when(cue, 1).otherwise(says(F.lit(False), before.rlike(FOREIGN)))
    behind = F.when(after.rlike(COUNTED), -1).otherwise(by_kind({"name": says(after.rlike(SAID)), "address": says(c["after"].rlike(PLACE))}))
    beside = says(company)
    line = says(c["before"].rlike(r"(?:^|\n)[^\n]{0,30}:\x20?$"), c["before"].rlike(r"[0-9|\t;]\x20?$") & c["after"].rlike(r"^\x20?[0-9|\t;]"))
    return [form, gazetteer, ahead, behind, beside, line]


def candidates(text: Column, company: Column) -> Column:
    """(kind, start, end, votes, traits) of each candidate; votes and traits are numbers of features."""

    def judged(c):
        def told(kind):
            votes = votes_of(kind, c, company)
            said = F.array(*[F.lit(3 * j + 1) + v for j, v in enumerate(votes)])
            size, marks = c["end"] - c["start"], lambda s: F.when(s == "", 0).when(s.rlike(r"^\s$"), 1).when(s.rlike(r"^\p{P}$"), 2).otherwise(3)
            traits = F.array(
                F.lit(VOTES) + kind, F.lit(VOTES + len(SHAPES)) + F.when(size < 8, 0).when(size < 12, 1).when(size < 20, 2).otherwise(3),
                F.lit(VOTES + len(SHAPES) + 4) + marks(F.substring(c["before"], -1, 1)), F.lit(VOTES + len(SHAPES) + 8) + marks(F.substring(c["after"], 1, 1)),
            )
            return F.struct(kind.alias("kind"), c["start"].alias("start"), c["end"].alias("end"), said.alias("votes"), traits.alias("traits"))

        return let(kind_of(c["text"]), told)

    found = F.when(text.rlike(MORE_THAN_NAMES), located(text, CANDIDATE, contexts=True)).otherwise(located(text, SHAPES["name"], contexts=True))
    return F.filter(F.transform(found, judged), lambda c: c["kind"].isNotNull())


FEATURES = VOTES + len(SHAPES) + 12


def weighed(features: Column, weights: list[float]) -> Column:
    """The sum of the weights of features."""
    table = F.array(*[F.lit(float(w)) for w in weights])
    return F.aggregate(features, F.lit(0.0), lambda s, i: s + F.get(table, i))


def chance(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def summed(table: DataFrame, share: Column) -> dict[int, tuple[float, float]]:
    """By feature, over table(features, n): the rows that have it, each counting share, and all that have it."""
    each = table.select(F.explode("features").alias("feature"), "n", share.alias("p")).groupBy("feature")
    return {r["feature"]: (r["p"], r["n"]) for r in each.agg(F.sum(F.col("n") * F.col("p")).alias("p"), F.sum("n").alias("n")).collect()}


def reliabilities(patterns: DataFrame, rounds: int = ROUNDS) -> list[float]:
    """The weight of each vote and each kind in a candidate's log odds, by expectation-maximisation over patterns(features, n).
    Pseudo-counts hold labelers to be better than chance where little is known; the first posteriors follow from
    the votes' sum."""
    weights = [0.8 * (f % 3 - 1) if f < VOTES else -0.5 for f in range(FEATURES)]
    for _ in range(rounds):
        sums = summed(patterns, chance(weighed(F.col("features"), weights)))
        yes, every = (sum(sums.get(VOTES + k, (0.0, 0))[x] for k in range(len(SHAPES))) for x in (0, 1))
        new = list(weights)
        for j in range(len(LABELERS)):
            for v in range(3):
                p, n = sums.get(3 * j + v, (0.0, 0))
                new[3 * j + v] = math.log((p + 1 + v) / (yes + 6)) - math.log((n - p + 3 - v) / (every - yes + 6))
        for k in range(len(SHAPES)):
            p, n = sums.get(VOTES + k, (0.0, 0))
            new[VOTES + k] = math.log((p + 1) / (n - p + 2))
        moved, weights = max(abs(a - b) for a, b in zip(weights, new, strict=True)), new
        if moved < 1e-4:
            break
    return weights


def classifier(patterns: DataFrame, posterior: Column, rounds: int = ROUNDS) -> list[float]:
    """Weights of a logistic classifier over all features, trained on the posteriors. Each round moves every weight by
    its gradient over a bound of its curvature, so the loss never rises; a small penalty keeps weights of rare features near 0."""
    weights, most = [0.0] * FEATURES, len(LABELERS) + 4
    aims = summed(patterns, posterior)
    for _ in range(rounds):
        sums = summed(patterns, chance(weighed(F.col("features"), weights)))
        steps = [(aims[f][0] - sums[f][0] - 0.5 * weights[f]) / (0.25 * most * aims[f][1] + 0.5) if f in aims else 0.0 for f in range(FEATURES)]
        weights = [w + s for w, s in zip(weights, steps, strict=True)]
        if max(map(abs, steps)) < 1e-4:
            break
    return weights


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, added) for each row of docs: spans has all spans as kind:start:end, by
    kind as in KINDS, then start; added has those beyond the base kinds as an array of (kind, start, end)."""
    with scratch(docs.sparkSession) as s:
        rows = docs.select(F.col(quoted(id_col)).alias("id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
        rows = rows.select("*", *[F.transform(v, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(k) for k, v in base_spans(F.col("text")).items()])
        count = sum((F.size(k) for k in BASE), F.lit(0))
        open_text = F.col("text")
        for kind, (pattern, _, good) in RULES.items():
            open_text = F.when(F.size(kind) > 0, hidden(open_text, pattern, good)).otherwise(open_text)
        rows = rows.withColumn("company", count > 0).withColumn("text", F.when(count > 0, open_text).otherwise(F.col("text")))
        rows = s.save(rows.select("id", *BASE, candidates(F.col("text"), F.col("company")).alias("candidates")))

        every = rows.select(F.explode("candidates").alias("c")).groupBy(F.concat("c.votes", "c.traits").alias("features")).agg(F.count("*").alias("n"))
        every = s.save(every)
        voted = s.save(every.groupBy(F.slice("features", 1, len(LABELERS) + 1).alias("features")).agg(F.sum("n").alias("n")))
        learned = None
        if voted.limit(1).count():
            reliable = reliabilities(voted)
            learned = classifier(every, chance(weighed(F.slice("features", 1, len(LABELERS) + 1), reliable)))
        wanted = F.lit(False) if learned is None else None

        def taken(c):
            if wanted is not None:
                return wanted
            return F.exists(F.slice(c["votes"], 1, OWN_VOTES), lambda v: v % 3 == 2) & (chance(weighed(F.concat(c["votes"], c["traits"]), learned)) >= threshold)

        written = lambda spans, kind: F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["start"], x["end"]))
        base = F.concat(*[written(F.col(k), (lambda name: lambda x: F.lit(name))(k)) for k in BASE])
        names = F.array(*map(F.lit, SHAPES))
        added = F.sort_array(F.transform(F.filter("candidates", taken), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))
        out = rows.select("id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], base.alias("base"), added.alias("found"))
        return s.keep(out.select(
            "id", *[f"n_{k}" for k in BASE], F.sha2(F.array_join("base", ","), 256).alias("base_sha256"),
            F.array_join(F.concat("base", written(F.col("found"), lambda x: F.get(names, x["kind"]))), ",").alias("spans"),
            F.transform("found", lambda x: F.struct(F.get(names, x["kind"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("added"),
        ))
