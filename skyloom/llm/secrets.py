"""Secret scan: fixed patterns plus character Markov models of random strings and ordinary identifiers.

The models are first-order chains over ALPHABET, one trained on random strings and one on ordinary
identifiers; a token is a secret if its log-likelihood ratio, in total and per step, is high.
Everything runs as column expressions; a document never leaves its row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bound, pieces, quoted, running, running_totals

#: Kinds in listed order, with their patterns.  The lower bounds inside `access` and `hex`
#: select the same matches as an unbounded pattern with short matches dropped, as both are maximal runs.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: Least log-likelihood ratio in thousandths of a nat: of a whole token, and per step.
LEAST_TOTAL, LEAST_MEAN = 12000, 500

#: Ordinary words from which the sample of identifiers is made.
WORDS = """account action address after amount android apply array article attribute author available average background balance
base before begin between binary block border bottom branch buffer build button bytes cache calendar call cancel category cell
change channel character check child class clear client close cluster code collect color column command comment common complete
config connect content context control convert copy count country create current customer data database date debug default
delete description detail device different dimension direction directory display distance document domain download driver edit
element email empty enable encode entry environment error event example execute export express extension factory feature field
file filter final first folder format forward function general generate global graph group handle header height history house
image import index information initial input insert instance integer interface internal iterator journal keyboard language large
layer length level library light limit line list load local location logger machine manager mapping market master matrix member
memory message method minimum model module monitor month mouse name network number object observation offset operation option
order organization output package page parameter parent password pattern payment performance picture pipeline platform player
point position previous price primary process product profile program project property provider public quality query question""".split()


def samples(spark: SparkSession, n: int = 6000) -> DataFrame:
    """Labelled training strings (text, label): label 1 random in the hex, base-32-like, base-64 and base-62
    alphabets, from a hash of a running number; label 0 identifiers joined from WORDS."""
    words = F.split(F.lit(" ".join(WORDS)), " ")
    pick = lambda salt: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(WORDS))) + 1).cast("int"))
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(digest))
    plain = F.translate(b64, "+/=", "")
    random = F.when(F.col("id") % 4 == 0, F.substring(digest, 1, 40)).when(F.col("id") % 4 == 1, F.upper(F.substring(plain, 1, 20))).when(F.col("id") % 4 == 2, F.substring(b64, 1, 40)).otherwise(F.substring(plain, 1, 32))
    a, b, c = pick(1), pick(2), pick(3)
    kind = F.col("id") % 6
    named = (F.when(kind == 0, F.concat_ws("_", a, b, c)).when(kind == 1, F.concat(a, F.initcap(b), F.initcap(c))).when(kind == 2, F.concat_ws("-", a, b, c))
             .when(kind == 3, F.upper(F.concat_ws("_", a, b))).when(kind == 4, F.concat(F.initcap(a), b, c)).otherwise(F.concat_ws("/", a, b, F.concat(c, (F.col("id") % 10).cast("string")))))
    ids = spark.range(n)
    return ids.select(random.alias("text"), F.lit(1).alias("label")).union(ids.select(named.alias("text"), F.lit(0).alias("label")))


def train(labelled: DataFrame) -> list[int]:
    """Log-likelihood ratios log P(b|a, random) - log P(b|a, identifier), in thousandths, at index of(a) * len + of(b).

    Transitions are counted on the executors with add-one smoothing; the table has len(ALPHABET)^2 entries
    whatever the sample.  Null texts and characters outside ALPHABET count for nothing.
    """
    k = len(ALPHABET)
    text = F.coalesce(F.col("text"), F.lit(""))
    pairs = (labelled.select(F.col("label"), text.alias("text")).where(F.length("text") > 1)
             .select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: F.col("text").substr(i, F.lit(2)))).alias("p"))
             .groupBy("label", "p").count())
    place = lambda i: F.position(F.substring("p", i, 1), F.lit(ALPHABET)) - 1
    pairs = pairs.select("label", place(1).alias("a"), place(2).alias("b"), "count")
    pairs = pairs.where("a >= 0 and b >= 0").groupBy("a", "b").agg(*[F.sum(F.when(F.col("label") == y, F.col("count")).otherwise(0)).alias(f"n{y}") for y in (0, 1)])
    grid = labelled.sparkSession.range(k * k).select((F.col("id") / k).cast("int").alias("a"), (F.col("id") % k).cast("int").alias("b")).join(F.broadcast(pairs), ["a", "b"], "left").fillna(0)
    rows = grid.groupBy("a").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
    lr = F.log((F.col("n1") + 1) / (F.col("t1") + k)) - F.log((F.col("n0") + 1) / (F.col("t0") + k))
    out = grid.join(rows, "a").select((F.col("a") * k + F.col("b")).alias("i"), F.round(lr * 1000).cast("int").alias("v")).collect()
    table = [0] * (k * k)
    for r in out:
        table[r.i] = r.v
    return table


def token_ratio(token: Column, table: Column) -> Column:
    """Summed log-likelihood ratio of a token over ALPHABET, in thousandths."""
    k = len(ALPHABET)
    codes = F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.position(token.substr(i, F.lit(1)), F.lit(ALPHABET)) - 1)
    return F.aggregate(F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes)), lambda a, b: F.element_at(table, (a * k + b + 1).cast("int"))), F.lit(0), lambda x, y: x + y)


_SPANS = "array<struct<start:bigint,kind:int,end:bigint,match:string>>"


def _spans(text: Column, pattern: str, kind: int, among: Column | None = None) -> Column:
    """All matches, leftmost first, with their places in code points, from the lengths of what lies between them.  Matches stay in
    the array for as long as a later step reads them."""
    none = F.array().cast(_SPANS)

    def made(matches: Column) -> Column:
        between = F.split(text, pattern, -1)
        sizes = F.zip_with(F.slice(between, 1, F.size(matches)), matches, lambda a, b: (F.length(a) + F.length(b)).cast("long"))
        return F.zip_with(running_totals(sizes), matches, lambda e, t: F.struct((e - F.length(t)).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), t.alias("match")))

    found = bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, made(m)).otherwise(none))
    return found if among is None else F.when(among, found).otherwise(none)


def _count_below(sorted_: Column, value: Column) -> Column:
    """How many of an ascending array<long> are less than `value`, by bisection."""
    start = F.struct(F.lit(0).alias("lo"), F.size(sorted_).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        less = F.get(sorted_, mid) < value
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(less, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(less, s["hi"]).otherwise(mid).alias("hi")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(31)), start, step, lambda s: s["lo"])


def _scanned(text: Column, table: list[int], least_total: int, least_mean: int) -> Column:
    """All spans of a text, sorted by start then kind."""
    model = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")

    def random(s: Column, m: Column) -> Column:
        total = token_ratio(s["match"], m)
        return (total >= least_total) & (total >= least_mean * (s["end"] - s["start"] - 1))

    def added(t: Column, base: Column, assigned: Column) -> Column:
        # an access or hex span lies inside one token; assigned spans are apart and ascending, so those that end
        # after a token's start and those that start before its end are counted by bisection
        def of(ends: Column, starts: Column) -> Column:
            apart = lambda s: F.when(F.size(ends) == 0, True).otherwise(_count_below(ends, s["start"] + 1) >= _count_below(starts, s["end"]))
            return bound(model, lambda m: F.filter(_spans(t, TOKEN, 3), lambda s: ~s["match"].rlike(HEX) & ~s["match"].rlike(ACCESS) & apart(s) & random(s, m)))

        place = lambda c: F.transform(assigned, lambda s: s[c])
        return F.sort_array(F.concat(base, bound(place("end"), lambda e: bound(place("start"), lambda b: of(e, b)))))

    def whole(t: Column) -> Column:
        assign = F.filter(_spans(t, ASSIGN, 0, t.rlike("[:=]")), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 12)
        return bound(assign, lambda a: added(t, F.concat(a, _spans(t, ACCESS, 1, F.contains(t, F.lit("AKIA"))), _spans(t, HEX, 2)), a))

    return bound(F.coalesce(text, F.lit("")), whole)


def scan(docs: DataFrame, table: list[int], text: str = "text", least_total: int = LEAST_TOTAL, least_mean: int = LEAST_MEAN) -> DataFrame:
    """(`row`, `spans`): each row of `docs` as a struct, and array<struct<start, kind, end, match>> sorted by start then kind.

    kind indexes KINDS.  A Markov span is a token of 20 or more characters that touches no base span.
    Null text: no spans.  Repeated rows each get their spans.  Work takes time in proportion to the text, however many spans it has.
    """
    d = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"))
    return d.withColumn("spans", _scanned(F.col("row")[text], table, least_total, least_mean))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced; overlapping spans fall under one mark."""
    def gaps(ss: Column, reach: Column, t: Column) -> Column:
        before = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(reach, i - 1))
        gap = F.transform(ss, lambda s, i: F.struct(before(i).alias("start"), s["start"].alias("end")))
        rest = F.array(F.struct(F.element_at(reach, -1).alias("start"), F.length(t).cast("long").alias("end")))
        kept = bound(F.concat(gap, rest), lambda g: pieces(t, g))
        # a span that starts inside what an earlier one covers has start > end here and no mark of its own
        first = F.transform(ss, lambda s, i: F.when((i == 0) | (s["start"] >= before(i)), mark).otherwise(""))
        return F.array_join(F.zip_with(kept, first, lambda k, m: F.concat(k, F.coalesce(m, F.lit("")))), "")

    def of(t: Column) -> Column:
        return bound(spans, lambda ss: F.when(F.size(ss) == 0, t).otherwise(
            bound(running(F.transform(ss, lambda s: s["end"]), lambda x, y: F.greatest(x, y)), lambda reach: gaps(ss, reach, t))))

    return F.when(text.isNotNull(), bound(text, of))


def secret_digest(docs: DataFrame, table: list[int] | None = None) -> DataFrame:
    """Contract columns of the secret scan, one row per document row (repeated rows repeat; null text is empty)."""
    table = train(samples(docs.sparkSession)) if table is None else table
    s = scan(docs.select("doc_id", "text"), table)
    base = F.filter("spans", lambda x: x["kind"] < 3)
    n = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return s.select("row.doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), n(3).alias("n_markov"),
                    F.sha2(F.encode(written(base), "utf-8"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, table: list[int] | None = None) -> DataFrame:
    """`docs` with secrets masked in `text`; all rows and columns stay whatever their names, null texts stay null."""
    table = train(samples(docs.sparkSession)) if table is None else table
    clean = redacted(F.col("row.text"), F.col("spans"))
    return scan(docs, table).select(*[(clean if c == "text" else F.col(f"row.{quoted(c)}")).alias(c) for c in docs.columns])
