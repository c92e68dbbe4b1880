"""Personal data: detection, span resolution, treatments, rewriting and restoring. DataFrame functions only.

Offsets count characters. Detection marks every match with private-use signs and reads the marks back, so one pass of
the pattern engine gives all spans of a pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.shared import numbered, shared_path

# Categories with their placeholders.
PLACEHOLDERS = {
    "Per": "PERSON", "Org": "ORG", "OrgForm": "ORG_FORM", "OrgSector": "SECTOR", "OrgStruct": "STRUCT", "Role": "ROLE",
    "Judge": "JUDGE", "Lawyer": "LAWYER", "Addr": "ADDR", "AddrCity": "CITY", "AddrDept": "DEPT", "AddrCountry": "COUNTRY",
    "DateAbs": "DATE", "DateRel": "DATE_REL", "Amount": "AMOUNT", "AmountRange": "RANGE", "Ratio": "RATIO",
    "IdNat": "ID_NAT", "IdFin": "ID_FIN", "IdReg": "ID_REG", "IdProp": "ID_PROP", "IdImmo": "ID_IMMO",
    "Contact": "CONTACT", "JurisRef": "JURIS_REF", "LawRef": "LAW_REF", "ContractRef": "CONTRACT_REF",
    "AssetDesc": "ASSET", "Zone": "ZONE", "Ccn": "CCN", "FinStruct": "FIN",
}
PROFILES = ("max", "deal", "litige", "contrat", "social", "immo", "restruct")
# Treatments by category in the order of PROFILES; M mask, K keep, G generalize, P pseudonym, R relativize.
TREATMENTS = {
    "Per": "MPPPPPP", "Org": "MPPPPPP", "OrgForm": "KKKKKKK", "OrgSector": "KKKKKKK", "OrgStruct": "KKKKKKK", "Role": "KKKKKKK",
    "Judge": "MPPMPMP", "Lawyer": "MPPPPPP", "Addr": "MMGGMKM", "AddrCity": "MKKKKKK", "AddrDept": "KKKKKKK", "AddrCountry": "KKKKKKK",
    "DateAbs": "MRRRRRK", "DateRel": "KKKKKKK", "Amount": "MGGGGGG", "AmountRange": "MGGGGGG", "Ratio": "KKKKKKK",
    "IdNat": "MMMMMMM", "IdFin": "MMMMMMM", "IdReg": "MMKKKKK", "IdProp": "MMKMMKK", "IdImmo": "MMKMMKM",
    "Contact": "MMMMMMM", "JurisRef": "KKKKKKK", "LawRef": "KKKKKKK", "ContractRef": "MKKKKKK",
    "AssetDesc": "MGGGMKG", "Zone": "KKKKKKK", "Ccn": "MMKMKMM", "FinStruct": "MKKKKKK",
}
NAMES = {"M": "mask", "K": "keep", "G": "generalize", "P": "pseudonym", "R": "relativize"}
# Pseudonyms by profile; other profiles use those of ``max``.
POOLS = {
    "max": ["Entity Alpha", "Entity Beta", "Entity Gamma", "Entity Delta", "Entity Epsilon", "Entity Zeta", "Entity Eta", "Entity Theta"],
    "deal": ["Company Alpha", "Company Beta", "Company Gamma", "Company Delta", "Company Epsilon", "Company Zeta", "Company Eta", "Company Theta"],
    "litige": ["Party A", "Party B", "Party C", "Party D"],
    "contrat": ["Supplier", "Client", "Provider Alpha", "Provider Beta", "Counterparty A", "Counterparty B"],
    "social": ["Employer Alpha", "Employer Beta", "Employee A", "Employee B", "Union Representative", "HR Entity"],
    "immo": ["Landlord Alpha", "Tenant A", "Tenant B", "Property Manager", "SCI Alpha", "Investor Alpha"],
    "restruct": ["Holding Alpha", "Holding Beta", "Subsidiary A", "Subsidiary B", "Creditor Alpha", "Creditor Beta", "Advisor Alpha"],
}
# The French legal patterns, (?iU) for Unicode classes and case folding.
LEGAL = (
    ("Role", r"(?iU)\b(Président(?:e)?|Directeur\s+Général(?:e)?|DG|PDG|Gérant(?:e)?|Associé(?:e)?|Mandataire|Représentant(?:e)?)\b"),
    ("Judge", r"(?iU)\b(Monsieur|Madame|M\.|Mme\.?)\s+le\s+[Jj]uge\b|\bConseil(?:ler)?\s+(?:rapporteur|instructeur)\b"),
    ("Lawyer", r"(?iU)\bMa[îi]tre\s+[A-ZÉÈÊËÀÂÙÛÜ][a-zéèêëàâùûü\-]+(?:\s+[A-ZÉÈÊËÀÂÙÛÜ][a-zéèêëàâùûü\-]+)*\b"),
    ("LawRef", r"(?iU)\b(?:Art(?:icle)?\.?\s+[LRD]\.?\s*\d+(?:[-.]\d+)*|L\.?\s*\d+(?:[-.]\d+)+\s+(?:du\s+)?[Cc]ode\b)"),
    ("Ccn", r"(?iU)\bCCN\s+[A-ZÀ-Ü][a-zà-ü\s]{3,50}|\bconvention\s+collective\s+(?:nationale\s+)?(?:de\s+)?[A-ZÀ-Ü][a-zà-ü\s]{3,50}"),
    ("Amount", r"(?iU)\b\d[\d\s]*(?:[.,]\d+)?\s*(?:€|EUR|K€|M€|milliard(?:s)?\s*d'euros?|million(?:s)?\s*d'euros?)"),
    ("AmountRange", r"(?iU)\b(?:entre|de)\s+\d[\d\s]*(?:[.,]\d+)?\s*(?:€|EUR|K€|M€)\s+(?:et|à)\s+\d[\d\s]*(?:[.,]\d+)?\s*(?:€|EUR|K€|M€)"),
    ("Ratio", r"(?iU)\b\d+(?:[.,]\d+)?(?:x\s*EBITDA|%\s*(?:du\s+)?(?:capital|chiffre\s+d'affaires?|CA)|fois\s+le\s+résultat)\b"),
    ("DateRel", r"(?iU)\b(?:J[+\-]\d+|dans\s+\d+\s+(?:jours?|semaines?|mois|ans?)|sous\s+\d+\s+(?:jours?|semaines?|mois)|délai\s+de\s+\d+\s+(?:jours?|semaines?|mois|ans?))\b"),
    ("IdProp", r"(?iU)\b(?:brevet(?:\s+d'invention)?|EP\s*\d{5,7}|FR\s*\d{6,10}|marque\s+(?:déposée|enregistrée)\s*(?:n°\s*)?\d+)\b"),
    ("IdImmo", r"(?iU)\b(?:parcelle\s+(?:cadastrale\s*)?(?:n°\s*)?\w+|lot\s+(?:cadastral\s*)?(?:n°\s*)?\w+|section\s+cadastrale\s+[A-Z]+\s*\d+)\b"),
    ("Zone", r"(?iU)\b(?:zone\s+(?:PLU\s*)?U[A-Z]?\b|ICPE\s+(?:rubrique\s+)?\d+|Natura\s+2000|zone\s+(?:naturelle|agricole|à\s+urbaniser|urbaine))\b"),
    ("FinStruct", r"(?iU)\b(?:chiffre\s+d'affaires?|CA\b|EBITDA|capitaux\s+propres|résultat\s+(?:net|d'exploitation|opérationnel)|endettement\s+(?:net|brut)|levier\s+(?:financier)?)\b"),
    ("OrgForm", r"(?U)\b(?:SAS|SARL|SA\b|SCI\b|SNC|SASU|EURL|GIE|SC\b|SCOP|SE\b|SLP|SELAFA|SELARL|SELAS)\b"),
)
# Our own patterns for structured data, as the reference's detector of these is a library that is not part of it.
STRUCTURED = (
    ("Contact", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("IdFin", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("Contact", r"(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){2,4}"),
    ("DateAbs", r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b|\b[0-9]{2}[/.][0-9]{2}[/.][0-9]{4}\b"),
)
# What a match of a pattern must hold: of each group one text at least, in lower case where the pattern's case does not count.
NEEDLES = {
    LEGAL[0][1]: (("président", "directeur", "dg", "gérant", "associé", "mandataire", "représentant"),),
    LEGAL[1][1]: (("juge", "conseil"),),
    LEGAL[2][1]: (("maitre", "maître"),),
    LEGAL[3][1]: (("art", "code"), ("l", "r", "d")),
    LEGAL[4][1]: (("ccn", "convention"),),
    LEGAL[5][1]: (("€", "eur"),),
    LEGAL[6][1]: (("€", "eur"), ("entre", "de")),
    LEGAL[7][1]: (("ebitda", "%", "fois"),),
    LEGAL[8][1]: (("j+", "j-", "dans", "sous", "délai"),),
    LEGAL[9][1]: (("brevet", "ep", "fr", "marque"),),
    LEGAL[10][1]: (("parcelle", "lot", "section"),),
    LEGAL[11][1]: (("zone", "icpe", "natura"),),
    LEGAL[12][1]: (("chiffre", "ca", "ebitda", "capitaux", "résultat", "endettement", "levier"),),
    LEGAL[13][1]: (("SA", "SC", "SN", "EURL", "GIE", "SE", "SL"),),
    STRUCTURED[0][1]: (("@",),),
    STRUCTURED[2][1]: (("-", " ", "."),),
    STRUCTURED[3][1]: (("-", "/", "."),),
}
# Patterns whose matches hold a number, and what a number is there.
NUMBERED = {LEGAL[i][1]: r"\p{Nd}" for i in (3, 5, 6, 7)} | {x[1]: "[0-9]" for x in STRUCTURED[1:]}
#: Letters that a pattern without case takes for others, though their lower case is not the same.
FOLDED = ("ſİıK", "siik")
BLOCKED = "[PII_DETECTION_ERROR: content blocked]"
OPEN, CLOSE = "", ""
SPAN = "array<struct<start int, end int, category string, value string, rule int>>"


def folded(text: Column) -> Column:
    """The text in lower case, in which NEEDLES of patterns without case are looked for."""
    return F.lower(_translated(text, *FOLDED))


def _translated(text: Column, signs: str, by: str) -> Column:
    """Signs replaced one by one; texts without any, nearly all, are only searched for them."""
    some = F.lit(False)
    for sign in signs:
        some = some | F.contains(text, F.lit(sign))
    return F.when(some, F.translate(text, signs, by)).otherwise(text)


def may_match(text: Column, low: Column, pattern: str) -> Column:
    """Whether a text holds what every match of a pattern holds; a plain search of a few words costs far less than a pattern."""
    where = low if pattern.startswith("(?i") else text
    out = F.lit(True)
    for group in NEEDLES.get(pattern, ()):
        one = F.lit(False)
        for needle in group:
            one = one | F.contains(where, F.lit(needle))
        out = out & one
    return out & text.rlike(NUMBERED[pattern]) if pattern in NUMBERED else out


def spans_of(text: Column, category: str, pattern: str, rule: int = 0, low: Column | None = None) -> Column:
    """All matches of a pattern as spans (start, end, category, value, rule), ends exclusive. ``low`` is ``folded`` of the text."""
    clean = _translated(text, OPEN + CLOSE, "  ")
    found = may_match(text, folded(text) if low is None else low, pattern)
    marked = F.when(found, F.split(F.regexp_replace(clean, pattern, OPEN + "$0" + CLOSE), OPEN)).otherwise(F.array(F.lit("")))

    def step(a: Column, part: Column) -> Column:
        value, rest = F.substring_index(part, CLOSE, 1), F.substring_index(part, CLOSE, -1)
        end = a["at"] + F.length(value)
        span = F.struct(a["at"].alias("start"), end.alias("end"), F.lit(category).alias("category"), value.alias("value"), F.lit(rule).alias("rule"))
        return F.struct((end + F.length(rest)).alias("at"), F.concat(a["spans"], F.array(span)).alias("spans"))

    def read(m: Column) -> Column:
        first = F.struct(F.length(F.get(m, F.lit(0))).alias("at"), F.array().cast(SPAN).alias("spans"))
        return F.aggregate(F.slice(m, F.lit(2), F.size(m)), first, step, lambda a: a["spans"])

    # Bound once, so that the pattern runs once over each text.
    return F.transform(F.array(marked), read)[0]


def detect(text: Column, patterns=LEGAL + STRUCTURED) -> Column:
    """Spans of all patterns, one after the other; null text has none."""
    t = F.coalesce(text, F.lit(""))
    both = F.struct(t.alias("t"), folded(t).alias("low"))
    return _bound(both, lambda x: F.flatten(F.array(*[spans_of(x["t"], c, p, i, x["low"]) for i, (c, p) in enumerate(patterns)])))


def _longest_first(spans: Column) -> Column:
    """Longest spans first, then earlier ones, then earlier rules; a span that overlaps a kept one goes."""
    ranked = F.array_sort(
        F.transform(spans, lambda s: F.struct((s["start"] - s["end"]).alias("short"), s["start"].alias("start"), s["rule"].alias("rule"), s.alias("s")))
    )
    return F.aggregate(
        ranked,
        F.array().cast(SPAN),
        lambda a, x: F.when(F.exists(a, lambda k: (x["s"]["start"] < k["end"]) & (x["s"]["end"] > k["start"])), a).otherwise(F.concat(a, F.array(x["s"]))),
    )


def dedup(spans: Column) -> Column:
    """Longest spans first, then earlier ones, then earlier rules; a span that overlaps a kept one goes. Sorted by start.

    Spans are taken in the order of their starts in groups that no other span reaches into, and only those of a group,
    a few as a rule, are compared with each other.
    """

    def step(a: Column, x: Column) -> Column:
        apart = x["start"] >= a["end"]
        return F.struct(
            F.when(apart, F.concat(a["done"], settled(a["group"]))).otherwise(a["done"]).alias("done"),
            F.when(apart, F.array(x)).otherwise(F.concat(a["group"], F.array(x))).alias("group"),
            F.greatest(a["end"], x["end"]).alias("end"),
        )

    def settled(group: Column) -> Column:
        return F.when(F.size(group) < 2, group).otherwise(_longest_first(group))

    none = F.array().cast(SPAN)
    start = F.struct(none.alias("done"), none.alias("group"), F.lit(-1).alias("end"))
    return F.array_sort(F.aggregate(F.array_sort(spans), start, step, lambda a: F.concat(a["done"], settled(a["group"]))))


def treatment(category: Column, profile: Column) -> Column:
    """The treatment of a category under a profile; custom and unknown profiles mask."""
    table = F.create_map(*[F.lit(x) for c, ts in TREATMENTS.items() for p, t in zip(PROFILES, ts, strict=True) for x in (f"{p}/{c}", NAMES[t])])
    return F.coalesce(table[F.concat(profile, F.lit("/"), category)], F.lit("mask"))


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def treat(spans: Column, profile: str) -> Column:
    """struct(spans, tokens) of one document's spans, sorted by start: each with ``treatment``, ``mapped`` and ``replacement``.

    Masks and pseudonyms are decided by the first occurrence of a value and numbered in text order; ``tokens`` lists
    them with their values. Everything happens within the row, so treating documents needs no exchange.
    """
    from millrace.functions import dates, numbers

    pool = POOLS.get(profile, POOLS["max"])
    bases = F.create_map(*[F.lit(x) for kv in PLACEHOLDERS.items() for x in kv])

    def known(x: Column) -> Column:
        of = treatment(x["category"], F.lit(profile))
        return _bound(of, lambda t: F.struct(*[x[c].alias(c) for c in ("start", "end", "category", "value")], t.alias("treatment"), F.when(t == "relativize", dates.parse_date(x["value"])).alias("day"), bases[x["category"]].alias("base")))

    def is_mapped(x: Column) -> Column:
        return x["treatment"].isin("mask", "pseudonym") | ((x["treatment"] == "relativize") & x["day"].isNull())

    def number(a: Column, x: Column) -> Column:
        named = (x["treatment"] == "pseudonym") & (a["named"] < len(pool))
        n = F.coalesce(a["counts"][x["base"]], F.lit(0)) + 1
        others = F.map_filter(a["counts"], lambda k, _: k != x["base"])
        mask = F.concat(F.lit("["), x["base"], F.lit("_"), n.cast("string"), F.lit("]"))
        name = F.get(F.array(*[F.lit(y) for y in pool]), a["named"])
        token = F.struct(F.when(named, name).otherwise(mask).alias("token"), x["value"].alias("value"))
        return F.struct(
            F.concat(a["tokens"], F.array(token)).alias("tokens"),
            F.when(named, a["counts"]).otherwise(F.map_concat(others, F.create_map(x["base"], n))).alias("counts"),
            F.when(named, a["named"] + 1).otherwise(a["named"]).alias("named"),
        )

    def finished(rows: Column) -> Column:
        mapped = F.filter(rows, is_mapped)
        values = F.transform(mapped, lambda x: x["value"])
        firsts = F.transform(F.array_distinct(values), lambda v: F.element_at(mapped, F.array_position(values, v).cast("int")))
        none = F.struct(
            F.array().cast("array<struct<token: string, value: string>>").alias("tokens"),
            F.create_map().cast("map<string, int>").alias("counts"),
            F.lit(0).alias("named"),
        )
        tokens = F.aggregate(firsts, none, number, lambda a: a["tokens"])
        dated = F.get(F.filter(rows, lambda x: x["day"].isNotNull()), F.lit(0))
        return F.struct(rows.alias("rows"), tokens.alias("tokens"), dated.alias("anchor"))

    def replaced(x: Column, of: Column, anchor: Column) -> Column:
        general = F.when(x["category"].isin("Amount", "AmountRange"), numbers.amount_range(x["value"])).when(
            x["category"] == "Addr", numbers.address_range(x["value"])
        ).otherwise(F.concat(F.lit("["), x["base"], F.lit("_GENERALIZED]")))
        date = dates.day_token(x["day"], anchor["day"], x["start"] == anchor["start"])
        new = F.when(is_mapped(x), of[x["value"]]).when(x["treatment"] == "keep", x["value"]).when(x["treatment"] == "generalize", general).otherwise(date)
        return F.struct(*[x[c].alias(c) for c in ("start", "end", "category", "value", "treatment")], is_mapped(x).alias("mapped"), new.alias("replacement"))

    def written(m: Column) -> Column:
        of = F.map_from_entries(F.transform(m["tokens"], lambda t: F.struct(t["value"], t["token"])))
        done = _bound(F.struct(of.alias("of"), m["rows"].alias("rows"), m["anchor"].alias("anchor")), lambda y: F.transform(y["rows"], lambda x: replaced(x, y["of"], y["anchor"])))
        return F.struct(done.alias("spans"), m["tokens"].alias("tokens"))

    return _bound(_bound(F.transform(spans, known), finished), written)


def treated(spans: DataFrame, profile: str) -> DataFrame:
    """Rows (session, start, end, category, value) with ``treatment``, ``mapped`` and ``replacement``; a session is one document."""
    own = F.array_sort(F.collect_list(F.struct("start", "end", "category", "value")))
    done = spans.groupBy("session").agg(own.alias("s")).select("session", treat(F.col("s"), profile)["spans"].alias("s"))
    return done.select("session", F.inline("s"))


def rewrite(text: Column, replacements: Column) -> Column:
    """The text with spans (start, end, replacement), sorted and free of overlaps, replaced."""
    made = F.aggregate(
        replacements,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, r: F.struct(r["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, r["start"] - a["at"]), r["replacement"]).alias("out")),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    return F.when(F.size(replacements) > 0, made).otherwise(text)


def anonymize(docs: DataFrame, profile: str = "max", patterns=LEGAL, key: str = "doc_id") -> DataFrame:
    """(key, text, pii_count, token_map, spans): each document rewritten as one session, in one pass without an exchange.

    ``spans`` are the treated spans. Rows are treated one by one, so null and repeated keys are nothing special.
    """
    # The generator is evaluated once for each row, however many of the columns behind it are used.
    found = docs.select(F.col(key).alias("__key"), "text", F.explode(F.array(treat(dedup(detect(F.col("text"), patterns)), profile))).alias("t"))
    return found.select(
        F.col("__key").alias(key),
        rewrite(F.col("text"), F.col("t.spans")).alias("text"),
        F.size("t.spans").cast("long").alias("pii_count"),
        F.map_from_entries(F.transform(F.array_distinct(F.transform("t.tokens", lambda x: x["token"])), lambda k: F.struct(k, F.element_at(F.filter("t.tokens", lambda x: x["token"] == k), 1)["value"]))).alias("token_map"),
        F.col("t.spans").alias("spans"),
    )


def detected(docs: DataFrame, patterns=STRUCTURED, key: str = "doc_id") -> DataFrame:
    """(__row, __key, text, __s): numbered rows with their resolved spans, written once; what needs the spans more than once reads them there.

    Detection is the costly part of a vault and of masking by it.
    """
    rows = numbered(docs.select(F.col(key).alias("__key"), "text"), "__row")
    path = shared_path(docs.sparkSession, "spans")
    rows.withColumn("__s", dedup(detect(F.col("text"), patterns))).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def vault(docs: DataFrame, patterns=STRUCTURED, key: str = "doc_id") -> DataFrame:
    """(category, value, token): stable ``CATEGORY_n`` tokens by first appearance over all documents.

    Values are reduced to one row each before they are numbered within their category. Of values that begin at one
    place, as none do after overlaps are resolved, the order would be open.
    """
    spans = docs.select(F.col(key).alias("doc"), F.inline_outer(dedup(detect(F.col("text"), patterns)))).where("start is not null")
    return _vault(spans)


def vault_of(found: DataFrame) -> DataFrame:
    """The ``vault`` of the documents whose spans ``detected`` has written."""
    return _vault(found.select(F.col("__key").alias("doc"), F.inline("__s")))


def _vault(spans: DataFrame) -> DataFrame:
    spark = spans.sparkSession
    firsts = spans.groupBy("category", "value").agg(F.min(F.struct("doc", "start")).alias("at"))
    # Numbered by ranges, which are written so that a second look finds the same ones; a window holds a range's rows.
    path = shared_path(spark, "vault")
    firsts.repartitionByRange("category", "at").withColumn("part", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    before = Window.partitionBy("category").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("category", "part").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    rows = ranged.join(F.broadcast(parts), ["category", "part"])  # a row for each category and partition
    nr = F.row_number().over(Window.partitionBy("category", "part").orderBy("at")) + F.col("before")
    base = F.create_map(*[F.lit(x) for kv in PLACEHOLDERS.items() for x in kv])[F.col("category")]
    return rows.select("category", "value", F.concat(base, F.lit("_"), nr.cast("string")).alias("token"))


def restore(text: Column, tokens: Column, pattern: str = r"\[[A-Z][A-Z0-9_]+_\d+\]") -> Column:
    """Tokens that the map knows replaced by their values in one pass; unknown ones stay."""
    marked = F.split(F.regexp_replace(F.translate(text, OPEN + CLOSE, "  "), pattern, OPEN + "$0" + CLOSE), OPEN)
    parts = F.transform(
        marked,
        lambda x, i: F.when(i == 0, x).otherwise(
            F.concat(F.coalesce(tokens[F.substring_index(x, CLOSE, 1)], F.substring_index(x, CLOSE, 1)), F.substring_index(x, CLOSE, -1))
        ),
    )
    return F.array_join(parts, "")


#: Words with a share of at least one in so many of all that are looked up are met by broadcast, as are at most so many.
COMMON_WORDS = 10_000
BROADCAST_CHARS = 1_000
TOKEN = r"\[[A-Z][A-Z0-9_]+_\d+\]"


def looked_up(asked: DataFrame, table: DataFrame, on: list[str], new: str, common: int = COMMON_WORDS) -> DataFrame:
    """Rows of ``asked`` with the column ``new`` of those rows of ``table`` (one for each ``on``) that they name.

    A word that a large share of the rows asks for would be one task of a join. There are at most ``common`` words with a
    share of 1 / ``common`` each; those, with values of at most BROADCAST_CHARS characters, are sent to the rows. The
    others, of which none is frequent or which Spark splits, meet their rows by a shuffle. ``asked`` is read three times.
    """
    counts = asked.groupBy(*on).agg(F.count("*").alias("__n"))
    total = asked.count()
    often = table.join(counts.where(F.col("__n") * common >= total), on).where(F.length(new) <= BROADCAST_CHARS).select(*on, new)
    sent = F.broadcast(often)
    return asked.join(sent, on).unionByName(asked.join(sent.select(*on), on, "left_anti").join(table.select(*on, new), on))


def _maps(known: DataFrame, word, new: str) -> DataFrame:
    """(__row, __m): what the words of each row stand for."""
    return known.groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct(word, F.col(new)))).alias("__m"))


def mask_by_vault(docs: DataFrame, tokens: DataFrame, patterns=STRUCTURED, key: str = "doc_id") -> DataFrame:
    """(key, text) with every value that the vault (category, value, token) knows in the form ``[token]``; other values stay.

    Detected values are looked up in the vault as rows, not as a map that a task would have to hold. Null and repeated keys
    and null texts are rows like others; texts without a known value stay as they are.
    """
    return mask_found(detected(docs, patterns, key), tokens, key)


def mask_found(found: DataFrame, tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """``mask_by_vault`` for documents whose spans ``detected`` has written."""
    values = F.array_distinct(F.transform("__s", lambda s: F.struct(s["category"].alias("category"), s["value"].alias("value"))))
    asked = found.select("__row", F.inline(values))
    maps = _maps(looked_up(asked, tokens, ["category", "value"], "token"), F.concat("category", F.lit("/"), "value"), "token")

    def replaced(s: Column, of: Column) -> Column:
        token = F.concat(F.lit("["), of[F.concat(s["category"], F.lit("/"), s["value"])], F.lit("]"))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.coalesce(token, s["value"]).alias("replacement"))

    done = found.join(maps, "__row", "left")
    return done.select(F.col("__key").alias(key), F.when(F.col("__m").isNull(), F.col("text")).otherwise(rewrite(F.col("text"), F.transform("__s", lambda s: replaced(s, F.col("__m"))))).alias("text"))


def rehydrate(docs: DataFrame, tokens: DataFrame, key: str = "doc_id", pattern: str = TOKEN) -> DataFrame:
    """(key, text) with every token ``[token]`` that the vault (category, value, token) knows replaced by its value.

    The distinct tokens of each text are looked up in the vault as rows, frequent ones by broadcast, and come back to the
    text as its own small map; unknown tokens stay. Null and repeated keys and null texts are rows like others.
    """
    spark = docs.sparkSession
    rows = numbered(docs.select(F.col(key).alias("__key"), "text"), "__row")
    own = F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))), lambda t: F.substring(t, F.lit(2), F.length(t) - 2))
    path = shared_path(spark, "tokens")
    rows.select("__row", F.explode(own).alias("token")).write.parquet(path)
    asked = spark.read.parquet(path)
    maps = _maps(looked_up(asked, tokens, ["token"], "value"), F.concat(F.lit("["), "token", F.lit("]")), "value")
    done = rows.join(maps, "__row", "left")
    return done.select(F.col("__key").alias(key), F.when(F.col("__m").isNull(), F.col("text")).otherwise(restore(F.col("text"), F.col("__m"), pattern)).alias("text"))
