"""Personal data: base patterns, and terms that give a protected entity away.

Information-theoretic sanitisation.  The entities to protect are the distinct
values that the base patterns find, an address or a number, and credentials: a
long value that a word such as "token" or "password" is set to.  Over all
documents, a term t that stands in a document with an entity c, however far from
it, leaves -log2 p(c | t) bits of the entity's information open, with p(c | t) =
n(c, t) / (n(t) + 1): one document more is taken to hold the term alone.  One
occurrence is no estimate: c and t must have met MEETINGS times independently.
What stands within CONTEXT characters of an entity, up to the next match, are its
surroundings: documents in which they are the same (copies, a signature) are one
meeting, and one document is several only for terms within different
surroundings.  A term that leaves at most GENERALISE bits is generalised in the
documents that hold an entity, and removed if it leaves at most REMOVE; one that
leaves at most CERTAIN is treated so in all other documents as well.  Thresholds are
bits left, so that they mean the same in a corpus of any size.  DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import plain_text, table, written

KINDS = ("email", "ip", "card", "phone")
#: All that is protected: the base kinds, and credentials.
ENTITIES = (*KINDS, "secret")

# The contract's patterns. What precedes a match, and loops that give nothing back, only spare
# the engine starts and retries that cannot succeed; the matches are the same.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# a value of sixteen characters and more with a digit in it, after a word that names a credential and = or :
VALUE = "A-Za-z0-9+/_~.-"
NAMES = "token|secret|password|passwd|pwd|credential|bearer|auth|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?key"
PATTERNS["secret"] = rf"(?<![{VALUE}])(?=[{VALUE}]{{16}})(?<=(?i:{NAMES})[\"']?\x20{{0,3}}[:=]\x20{{0,3}}[\"']?)(?=[A-Za-z+/_~.-]*+[0-9])[{VALUE}]++={{0,2}}"
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "secret": None}  # a character without which there is no match
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

CONTEXT = 200  # characters on each side of an entity by which its surroundings are told apart
MEETINGS = 2  # different surroundings of the entity with which a term is met, at least
GENERALISE, REMOVE, CERTAIN = 1.0, 0.25, 0.075  # bits of the entity's information that a term leaves open, at most
SALTS = 64
#: Rows of (text, its terms) up to which the texts that hold a certain term without the entity are found by broadcast; beyond, by shuffle.
MOST_BROADCAST = 50_000

SPANS = "array<struct<kind:string,start:int,end:int>>"


def valid(kind: str, value: Column) -> Column:
    """Whether a match is kept."""
    if kind == "ip":
        return value.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if kind == "card":
        digits = F.regexp_replace(value, "[^0-9]", "")
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def placed(pieces: Column, matches: Column) -> Column:
    """[(start, end, value)] in code points, from the matches and the pieces of text around them."""
    step = F.arrays_zip(F.slice(pieces, 1, F.size(matches)).alias("piece"), matches.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        lo = acc["at"] + F.length(x["piece"])
        hi = lo + F.length(x["value"])
        return F.struct(hi.alias("at"), F.concat(acc["out"], F.array(F.struct(lo.alias("start"), hi.alias("end"), x["value"].alias("value")))).alias("out"))

    return F.aggregate(step, start, add, lambda acc: acc["out"])


def matched(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` (row, text) with an array of matches and one of the pieces of text around them for each kind."""
    text = plain_text(column)
    digit = text.rlike("[0-9]")
    nothing = F.array().cast("array<string>")
    found = docs
    for kind in ENTITIES:
        worth = F.instr(text, NEEDS[kind]) > 0 if NEEDS[kind] else digit & text.rlike(f"(?i:{NAMES})") if kind == "secret" else digit
        found = found.withColumn(f"m_{kind}", F.when(worth, F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))).otherwise(nothing))
    return found.select("*", *[F.when(F.size(f"m_{kind}") > 0, F.split(text, PATTERNS[kind], -1)).alias(f"p_{kind}") for kind in ENTITIES])


def spans_of_matches(kinds: tuple[str, ...] = KINDS) -> Column:
    """The valid matches of each kind, in the kinds' order, then by start."""
    spans = []
    for kind in kinds:
        at = F.filter(placed(F.col(f"p_{kind}"), F.col(f"m_{kind}")), lambda s: valid(kind, s["value"]))  # noqa: B023
        typed = F.transform(at, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))  # noqa: B023
        spans.append(F.when(F.size(f"m_{kind}") > 0, typed).otherwise(F.array().cast(SPANS)))
    return F.concat(*spans)


def contexts_of_matches() -> Column:
    """(entity, near) of each valid match: its value, and the text before and after it."""
    out = []
    for kind in ENTITIES:
        pieces = F.col(f"p_{kind}")
        # the match, and the pieces on both sides; words cut by the limit are left out
        before = F.transform(pieces, lambda x: F.when(F.length(x) > CONTEXT, F.regexp_replace(F.substring(x, -CONTEXT, CONTEXT), r"^\p{L}+", "")).otherwise(x))
        after = F.transform(pieces, lambda x: F.when(F.length(x) > CONTEXT, F.regexp_replace(F.substring(x, 1, CONTEXT), r"\p{L}+$", "")).otherwise(x))
        sides = F.arrays_zip(F.col(f"m_{kind}").alias("value"), before.alias("before"), F.slice(after, 2, F.size(pieces)).alias("after"))
        held = F.filter(sides, lambda s: s["value"].isNotNull() & valid(kind, s["value"]))  # noqa: B023

        def entity(value: Column) -> Column:
            plain = value if kind in ("ip", "secret") else F.lower(value) if kind == "email" else F.regexp_replace(value, "[^0-9]", "")  # noqa: B023
            return F.concat(F.lit(f"{kind}:"), plain)  # noqa: B023

        typed = F.transform(held, lambda s: F.struct(entity(s["value"]).alias("entity"), F.concat_ws(" ", s["before"], s["after"]).alias("near")))  # noqa: B023
        out.append(F.when(F.size(f"m_{kind}") > 0, typed).otherwise(F.array().cast("array<struct<entity:string,near:string>>")))
    return F.concat(*out)


def with_base_spans(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with ``base_spans``, which replaces a column of that name."""
    found = matched(docs.select(F.struct(*docs.columns).alias("row"), plain_text(column).alias("text")))
    return found.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "base_spans"], spans_of_matches().alias("base_spans"))


def terms(text: Column) -> Column:
    """The distinct lower-case words of a text, those within e-mail addresses and credentials left out."""
    bare = F.when(F.instr(text, "@") > 0, F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    bare = F.when(bare.rlike(f"(?i:{NAMES})"), F.regexp_replace(bare, PATTERNS["secret"], " ")).otherwise(bare)
    return F.filter(F.array_distinct(F.split(lowered(bare), r"[^\p{L}]+", -1)), lambda t: t != "")


def lowered(text: Column) -> Column:
    """Lower case of the same length: the one capital that lowers to two characters is replaced first."""
    return F.lower(F.translate(text, "İ", "i"))


def met_terms(holding: DataFrame, spots: DataFrame) -> DataFrame:
    """(entity, term, n_both) of all that met often enough: n_both counts the documents in which both stand, anywhere in the text.

    ``holding`` (uid, text) are the documents with an entity, ``spots`` (uid, entity,
    near, words) its occurrences, ``near`` a hash of the surroundings.
    """
    # an entity whose surroundings are always the same meets nothing twice
    varied = spots.groupBy("entity").agg(F.count_distinct("near").alias("n")).filter(F.col("n") >= MEETINGS).select("entity")
    known = spots.join(varied, "entity")
    close = known.select("entity", "near", F.explode("words").alias("term")).groupBy("entity", "term").agg(F.count_distinct("near").alias("n"))
    close = close.filter(F.col("n") >= MEETINGS).select("entity", "term", F.lit(True).alias("close"))
    places = known.groupBy("uid", "entity").agg(F.xxhash64(F.sort_array(F.collect_set("near"))).alias("place"))
    by_text = places.groupBy("uid").agg(F.collect_list(F.struct("entity", "place")).alias("places"))
    apart = holding.select("uid", "text").join(by_text, "uid").select("places", F.explode(terms(F.col("text"))).alias("term")).select("term", F.explode("places").alias("x"))
    together = apart.groupBy("x.entity", "term").agg(F.count("*").alias("n_both"), F.count_distinct("x.place").alias("meetings"))
    return together.join(close, ["entity", "term"], "left").filter((F.col("meetings") >= MEETINGS) | F.col("close")).select("entity", "term", "n_both")


def disclosing_terms(docs: DataFrame, holding: DataFrame, spots: DataFrame) -> DataFrame:
    """(term, open, certain): terms that leave at most GENERALISE bits of an entity's information open.

    ``docs`` (text) are all documents; for the others see ``met_terms``.  certain:
    whether the term also stands where the entity does not, and points to it even
    there.
    """
    met = met_terms(holding, spots)
    # counted in each task before anything is shuffled; no term is sent more often than once by a task
    n_term = docs.select(F.explode(terms(plain_text())).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    left = -F.log2(F.col("n_both") / (F.col("n_term") + 1))
    return (
        met.join(n_term, "term").select("term", left.alias("open"), ((F.col("n_term") > F.col("n_both")) & (left <= CERTAIN)).alias("certain"))
        .filter(F.col("open") <= GENERALISE).groupBy("term").agg(F.min("open").alias("open"), F.max("certain").alias("certain"))
    )


def flags_by(places: DataFrame, key: str) -> DataFrame:
    """(key, flagged) of (key, term, open)."""
    return places.distinct().groupBy(key).agg(F.sort_array(F.collect_list(F.struct("term", "open"))).alias("flagged"))


def spanned(docs: DataFrame) -> DataFrame:
    """(row, text, base_spans, spans) of every row of ``docs``; row holds all its columns."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), plain_text().alias("text"))
    based = matched(packed).select("row", "text", spans_of_matches().alias("base_spans"), spans_of_matches(ENTITIES).alias("found"), contexts_of_matches().alias("contexts"))
    holds = F.size("found") > 0
    # documents with an entity are few: they alone are written, numbered, and take part in a join
    holding = written(based.filter(holds).withColumn("uid", F.monotonically_increasing_id()), "pii-holding")
    others = based.filter(~holds).select("row", "text", "base_spans", "found")
    near = holding.select("uid", F.explode("contexts").alias("x"))
    spots = written(near.select("uid", "x.entity", F.xxhash64("x.near").alias("near"), terms(F.col("x.near")).alias("words")), "pii-contexts")
    telling = written(disclosing_terms(docs, holding, spots), "pii-terms")
    places = holding.select("uid", F.explode(terms(F.col("text"))).alias("term")).join(telling.select("term", "open"), "term")
    certain = telling.filter("certain").select("term", "open")
    sought = not certain.isEmpty()
    wanted = ["row", "text", "base_spans"]
    out = holding.join(written(flags_by(places, "uid"), "pii-flagged"), "uid", "left").select(*wanted, term_spans().alias("spans"))
    if sought:
        # a salt of the other columns spreads copies of a text
        salting = [F.col("row")[c] for c, kind in docs.dtypes if c != "text" and "map<" not in kind]
        salt = F.pmod(F.xxhash64(*salting or [F.lit(0)]), F.lit(SALTS)).cast("int")
        found = others.select(F.md5("text").alias("key"), salt.alias("salt"), F.explode(terms(F.col("text"))).alias("term")).join(certain, "term").distinct()
        elsewhere = written(found.groupBy("key", "salt").agg(F.sort_array(F.collect_list(F.struct("term", "open"))).alias("flagged")), "pii-elsewhere")
        few = elsewhere.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
        others = others.withColumn("key", F.md5("text")).withColumn("salt", salt).join(F.broadcast(elsewhere) if few else elsewhere, ["key", "salt"], "left")
        return out.unionByName(others.select(*wanted, term_spans().alias("spans")))
    return out.unionByName(others.withColumn("spans", F.col("base_spans")).select(*wanted, "spans"))


def term_spans() -> Column:
    """The entities' spans, then the places in text of the flagged terms that overlap none of them."""
    low = lowered(F.col("text"))
    any_of = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(F.transform("flagged", lambda x: x["term"]), "|"), F.lit(r")(?!\p{L})"))
    gone = F.transform(F.filter("flagged", lambda x: x["open"] <= REMOVE), lambda x: x["term"])
    places = placed(F.split(low, any_of, -1), F.regexp_extract_all(low, any_of, F.lit(0)))
    clear = F.filter(places, lambda s: ~F.exists("found", lambda b: (s["start"] < b["end"]) & (s["end"] > b["start"])))
    typed = F.transform(clear, lambda s: F.struct(F.when(F.array_contains(gone, s["value"]), "removed").otherwise("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    by_kind = [F.filter(typed, lambda s: s["kind"] == kind) for kind in ("term", "removed")]  # noqa: B023
    return F.when(F.col("flagged").isNotNull(), F.concat("found", *by_kind)).otherwise(F.col("found"))


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``: base spans, then credentials ("secret") and disclosing terms ("term", "removed"), each by start.

    Null text counts as empty and has no spans; repeated rows get the same; an
    empty table gives no rows.  Columns named base_spans or spans are replaced,
    all others are kept as they are.
    """
    names = [c for c in docs.columns if c not in ("base_spans", "spans")]
    return spanned(docs).select(*[F.col("row")[c].alias(c) for c in names], "base_spans", "spans")


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs``, its columns in order, with the spans of its texts replaced by their kind in brackets; "removed" ones by nothing.

    Overlapping spans are replaced as one, by the first's kind.  n_chars, where
    there is such a column, is counted anew for texts that changed.  Null texts
    stay null, repeated rows stay, and other columns are kept whatever their
    names; an empty table gives no rows.
    """
    ordered = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        label = F.when(s["kind"] == "removed", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), label)).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    changed = F.size("spans") > 0
    out = spanned(docs).select("row", changed.alias("changed"), F.when(changed, clean).alias("clean"))
    columns = []
    for c in docs.columns:
        own = F.col("row")[c]
        if c == "text":
            own = F.when(F.col("changed"), F.col("clean")).otherwise(own)
        elif c == "n_chars":
            own = F.when(F.col("changed"), F.length("clean")).otherwise(own).cast(docs.schema[c].dataType)
        columns.append(own.alias(c))
    return out.select(*columns)


def listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all ``documents``."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_spans(docs).select(
        "doc_id",
        *[F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in KINDS],  # noqa: B023
        F.sha2(listed("base_spans"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )
