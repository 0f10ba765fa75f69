"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Fixed patterns find emails, ip addresses, card and phone numbers: leftmost and without overlap in each kind, places in
code points (ip: parts at most 255; card: 16 to 19 digits, Luhn; phone: 8 to 15 digits). Places are had from the
lengths of the pieces that split() leaves between the matches. Possessive forms and a look behind keep a pattern from
being tried again inside a run that it has refused, so a text of one long run takes linear time; the finds are the same.

The method looks at instances: the finds of the fixed patterns, what stands behind a cue (a colon, an equals or number
sign, a quote or bracket), and every token with a digit and six characters or more, wherever it stands. Their lexical
patterns are the word before with what lies between, and the two words before. The finds, and instances that look like
one of the kinds or are runs of 32 or more hexadecimal digits, are the seeds. Spark scores the graph of patterns and
instances in rounds: a pattern's confidence is the mean over its distinct instances, shrunk where they are few; an
instance's is the noisy-or over its confident patterns; seeds stay certain. What stands behind the same words without
being an identifier counts against a pattern: behind a cue each distinct instance, behind plain words every occurrence,
counted over all texts for the patterns that have support. Patterns of high confidence and support then mark the
identifiers behind them (kind `found`) whatever they look like: with a digit, of six characters or more.

Spans and instances are written, and all rounds work on aggregated edges. No pattern's or instance's rows are gathered
in one place: what a third of all texts share is one row of counts after partial sums. The trusted patterns, few beside
the texts, go with the tasks as a constant where they are counted to be at most `MOST_BYTES`, else they are joined, with
equal results. The query reads texts twice, for the instances and for the counts; the masking reads them once more, with
no shuffle while the patterns are few.

Defined results: a null or empty text has no spans. Repeated rows give repeated results. A null doc_id stays. Spans
found by the method that touch a fixed span are left out. An empty table gives no rows. Other columns are ignored by
the search and carried along by the masking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm.common import Sieve, columns_of, materialise, named, only_in, spread_join, table

KINDS = ("email", "ip", "card", "phone")
# The patterns of the four kinds, in forms that find the same without trying a run twice.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must have for a pattern to be tried.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]", "cue": r"""[:=#"'(\[<]""", "token": "[0-9]"}
CUE = r"""[:=#"'(\[<][\x20"'(\[<]{0,3}+[A-Za-z0-9+][A-Za-z0-9_.@+/-]*+"""
BEHIND_CUE = r"""[:=#"'(\[<][\x20"'(\[<]{0,3}$"""
TOKEN = r"(?<![\p{L}\p{N}_.@+/-])(?=[A-Za-z0-9_.@+/-]{6})(?=[A-Za-z_.@+/-]*+[0-9])[A-Za-z0-9+](?:[_.@+/-]*+[A-Za-z0-9])++"
WORD = r"[\p{L}\p{N}_]++[^\p{L}\p{N}_+]*+"
SEED = r"^(?:[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++|[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9]{16,19}|\+[0-9].*|[0-9A-Fa-f]{32,})$"
IDENTIFIER = r"^(?=.*[0-9]).{6,}$"
MOST_BYTES, SPREAD = 4 << 20, 16
MATCHES = "array<struct<start:int,end:int,match:string,before:string>>"


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""

    def value(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), value), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))
    if kind == "card":
        return F.when(F.length(_digits(match)).between(16, 19), _luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def located(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Adds a column of MATCHES for each pattern: (start, end, match, before) in code points; before: up to 40 characters since the match before.

    In steps that the optimizer keeps apart, since a later one names an earlier one's costly column more than once."""
    t = F.col(named(text))
    df = df.withColumns({f"{k}_m": F.when(t.contains(NEEDS[k]) if k == "email" else t.rlike(NEEDS[k]), F.regexp_extract_all(t, F.lit(p), F.lit(0))) for k, p in patterns.items()})
    df = df.withColumns({f"{k}_p": F.when(F.size(f"{k}_m") > 0, F.split(t, p, -1)) for k, p in patterns.items()})

    def places(k: str) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(MATCHES).alias("out"))

        def step(state: Column, x: Column) -> Column:
            begin = state["at"] + F.length(x["piece"])
            end = begin + F.length(x["match"])
            one = F.struct(begin.alias("start"), end.alias("end"), x["match"].alias("match"), F.right(x["piece"], F.lit(40)).alias("before"))
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

        pairs = F.zip_with(F.slice(f"{k}_p", F.lit(1), F.size(f"{k}_m")), F.col(f"{k}_m"), lambda p, m: F.struct(p.alias("piece"), m.alias("match")))
        return F.when(F.size(f"{k}_p") > 0, F.aggregate(pairs, start, step, lambda s: s["out"])).otherwise(F.array().cast(MATCHES))

    return df.withColumns({k: places(k) for k in patterns}).drop(*(f"{k}_{x}" for k in patterns for x in "mp"))


def _one_space(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[\t\r\n][\x20\t\r\n]*+|\x20[\x20\t\r\n]++", " ")  # single blanks stay as they are


def _instances(matches: Column, rank: int, *, cue: bool = False) -> Column:
    """(start, rank, end, instance, patterns) of matches; of those that start at one place the lowest rank is to count. cue: they begin with their cue."""

    def one(m: Column) -> Column:
        lead = F.regexp_extract(m["match"], r"^[^A-Za-z0-9+]+", 0) if cue else F.lit("")
        near = _one_space(F.concat(m["before"], lead))
        w1 = F.regexp_extract(near, r"([\p{L}\p{N}_]++[^\p{L}\p{N}_]*+)$", 1)
        w2 = F.regexp_extract(near, r"([\p{L}\p{N}_]++[^\p{L}\p{N}_]++[\p{L}\p{N}_]++[^\p{L}\p{N}_]*+)$", 1)
        patterns = F.filter(F.array_distinct(F.array(w1, w2)), lambda p: p != "")
        return F.struct((m["start"] + F.length(lead)).alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.substr(m["match"], F.length(lead) + 1).alias("instance"), patterns.alias("patterns"))

    return F.transform(matches, one)


def _kept(kind: str) -> Column:
    return F.filter(F.col(kind), lambda m: _passes(kind, m["match"]))


def _places(kind: str) -> Column:
    return F.transform(kind, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))


def entities_of(docs: DataFrame, key: str, text: str, *keep: Column) -> DataFrame:
    """doc_id, t (the text), the four kinds' spans and all instances (cues) of every document."""
    own = docs.select(F.col(named(key)).cast("long").alias("doc_id"), F.coalesce(F.col(named(text)).cast("string"), F.lit("")).alias("t"), *keep)
    found = located(own, "t", {**PATTERNS, "cue": CUE, "token": TOKEN}).withColumns({k: _kept(k) for k in KINDS})
    tokens = _instances(F.filter("token", lambda m: F.length(m["match"]) >= 6), 2)
    cues = F.array_sort(F.concat(*(_instances(F.col(k), 0) for k in KINDS), _instances(F.col("cue"), 1, cue=True), tokens))
    first = F.filter("cues", lambda x, i: (i == 0) | (F.get(F.col("cues"), i - 1)["start"] != x["start"]))
    return found.withColumn("cues", cues).withColumn("cues", first).withColumns({k: _places(k) for k in KINDS}).drop("cue", "token")


def search(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, the four kinds' spans and all instances of every document, written to a table."""
    found = entities_of(docs, key, text).select(F.monotonically_increasing_id().alias("row"), "doc_id", *KINDS, "cues")
    return materialise(found, "entities")  # written, so rows keep their numbers


def _counts(texts: Column | str, docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern and places: how often its words stand before another word or token in all texts. patterns: a written table."""
    n = patterns.count()
    sieve = Sieve(patterns.select(F.xxhash64("pattern").alias("h")), n)
    units = docs.select(F.regexp_extract_all(_one_space(texts), F.lit(WORD), F.lit(0)).alias("u"))
    # each word but the last with the one before it, looked up in the array beside it, so that all is generated code;
    # an outer explode, since for the other a filter on the size is put below the array, which is then made twice
    words = units.select("u", F.posexplode_outer("u").alias("i", "w")).where("i < size(u) - 1").select("w", F.coalesce(F.get("u", F.col("i") - 1), F.lit("")).alias("v"))
    one, two = sieve.may_hold(F.xxhash64("w")), (F.col("v") != "") & sieve.may_hold(F.xxhash64(F.concat("v", "w")))
    hits = words.where(one | two).select(F.explode(F.array(F.when(one, F.col("w")), F.when(two, F.concat("v", "w")))).alias("pattern")).where("pattern is not null")
    return only_in(hits.groupBy("pattern").agg(F.count("*").alias("places")), patterns, "pattern")


def trusted_patterns(found: DataFrame, docs: DataFrame, text: str = "text", *, rounds: int = 3, confidence: float = 0.7, support: int = 3) -> DataFrame:
    """pattern, conf and n (distinct instances) of the patterns that the graph's rounds trust. found: search of docs."""
    cues = found.select(F.explode("cues").alias("c")).select(F.lower("c.instance").alias("instance"), (F.col("c.rank") == 0).alias("sure"), F.explode("c.patterns").alias("pattern"))
    edges = cues.groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.max("sure").alias("sure"))
    edges = materialise(edges.withColumn("seed", F.col("sure") | F.col("instance").rlike(SEED)).drop("sure"), "edges")
    plain = edges.where(~F.col("pattern").rlike(BEHIND_CUE)).groupBy("pattern").agg(F.count("*").alias("kinds"), F.sum("n").alias("held"))
    plain = materialise(plain.where(F.col("kinds") >= support).drop("kinds"), "plain")
    others = _counts(F.col(named(text)).cast("string"), docs, plain).join(plain, "pattern", "right")
    others = materialise(others.select("pattern", F.greatest(F.coalesce("places", F.lit(0)) - F.col("held"), F.lit(0)).alias("others")), "others")
    sure = edges.withColumn("conf", F.col("seed").cast("double"))
    for _ in range(rounds):
        scored = sure.groupBy("pattern").agg(F.sum("conf").alias("conf"), F.count("*").alias("n")).where(F.col("n") >= support).join(others, "pattern", "left")
        scored = scored.select("pattern", (F.col("conf") / (F.col("n") + F.coalesce("others", F.lit(0)) + 1)).alias("conf"), "n")
        patterns = materialise(scored.where((F.col("conf") >= 0.5) & (F.col("n") >= support)), "patterns")
        held = spread_join(edges, patterns, "pattern", by="instance", n="n")
        ors = held.groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-F.least("conf", F.lit(0.99)))))).alias("conf"))
        known = F.when(F.col("seed"), F.lit(1.0)).when(F.col("instance").rlike(IDENTIFIER), F.coalesce("conf", F.lit(0.0))).otherwise(F.lit(0.0))
        sure = edges.join(ors, "instance", "left").withColumn("conf", known)
    return patterns.where(F.col("conf") >= confidence)


def _wanted(cue: Column) -> Column:
    return cue["instance"].rlike(IDENTIFIER) | cue["instance"].rlike(SEED)


def _constant(patterns: DataFrame, most_bytes: int) -> list[str] | None:
    """The patterns, if they are small enough to go with the tasks."""
    size = patterns.agg(F.coalesce(F.sum(F.octet_length("pattern") + 16), F.lit(0))).first()[0]
    return sorted(r[0] for r in patterns.select("pattern").collect()) if size <= most_bytes else None


def _add_found(entities: DataFrame, patterns: DataFrame, row: str, most_bytes: int) -> DataFrame:
    """Adds the spans behind trusted patterns (found) that touch no fixed span, in place of cues. row: a column that tells the entities apart, for the join."""
    constant = _constant(patterns, most_bytes)
    spans = F.array().cast("array<struct<start:int,end:int>>")
    if constant is not None:
        kept = F.filter("cues", lambda c: _wanted(c) & F.exists(c["patterns"], lambda p: p.isin(constant) if constant else F.lit(False)))
        found = entities.withColumn("found", F.array_sort(F.array_distinct(F.transform(kept, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"))))))
    else:
        behind = entities.select(row, F.explode("cues").alias("c")).where(_wanted(F.col("c")))
        behind = behind.select(row, "c.start", "c.end", F.explode("c.patterns").alias("pattern")).withColumn("_part", F.pmod(F.xxhash64(row), F.lit(SPREAD)))
        everywhere = patterns.select("pattern", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SPREAD - 1).cast("bigint"))).alias("_part"))
        marked = behind.join(everywhere, ["pattern", "_part"], "left_semi").groupBy(row).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("found"))
        found = entities.join(marked, row, "left").withColumn("found", F.coalesce("found", spans))
    free = F.filter("found", lambda f: ~F.exists(F.col("_base"), lambda b: (b["start"] < f["end"]) & (f["start"] < b["end"])))
    return found.drop("cues").withColumn("_base", F.concat(*KINDS)).withColumn("found", free).drop("_base")


def personal_data(docs: DataFrame, *, key: str = "doc_id", text: str = "text", most_bytes: int = MOST_BYTES, **how) -> DataFrame:
    """row, doc_id, the spans (start, end) of email, ip, card, phone and found of every document, each in order."""
    entities = search(docs, key, text)
    return _add_found(entities, trusted_patterns(entities, docs, text, **how), "row", most_bytes)


def _named(kind: str) -> Column:
    return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def _tagged(kind: str) -> Column:
    return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("name")))


def mask(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: str | None = None, most_bytes: int = MOST_BYTES, **how) -> DataFrame:
    """The documents with their spans replaced by [EMAIL] and so on; touching spans become one, named as the first. length: a column that follows the text's length."""
    patterns = trusted_patterns(search(docs, key, text), docs, text, **how)
    # the row number, not being deterministic, keeps the search from being done for every use of its spans
    entities = entities_of(docs, key, text, F.struct(*columns_of(docs)).alias("own"), F.monotonically_increasing_id().alias("row"))
    found = _add_found(entities if _constant(patterns, most_bytes) is not None else materialise(entities, "texts"), patterns, "row", most_bytes)
    t, cut = F.col("t"), F.array_sort(F.concat(*map(_tagged, (*KINDS, "found"))))

    def step(state: Column, s: Column) -> Column:
        new = F.concat(state["out"], F.substr(t, state["at"] + 1, s["start"] - state["at"]), s["name"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], new).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate(F.col("cut"), start, step, lambda s: F.concat(s["out"], F.substr(t, s["at"] + 1)))
    changed = F.size("cut") > 0
    new = found.withColumn("cut", cut).withColumn("masked", F.when(changed, masked))

    def column(c: str) -> Column:
        own = F.col(f"own.{named(c)}")
        if c.lower() == text.lower():
            own = F.when(changed, F.col("masked")).otherwise(own)
        elif length and c.lower() == length.lower():
            own = F.when(changed, F.length("masked").cast(docs.schema[c].dataType)).otherwise(own)
        return own.alias(c)

    return new.select(*map(column, docs.columns))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    found = personal_data(table(spark, sf_dir, "documents"))
    base, every = F.concat(*map(_named, KINDS)), F.concat(*map(_named, (*KINDS, "found")))
    return found.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(every, ",").alias("spans"), F.size(every).cast("long").alias("n_spans"), F.size("found").cast("long").alias("n_found"),
    )
