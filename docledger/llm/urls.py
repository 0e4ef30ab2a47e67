"""URL filtering: rules first, then logistic regression on hashed character n-grams of host and path.

Everything is DataFrame expressions. The model is trained by full-batch gradient descent inside one expression, over
a small labelled URL table; its weights (a fixed number of doubles) are then a literal of the scoring expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The n-gram sizes, hashed features, steps, step size and L2 weight of training, and how many labelled URLs and rules are taken at most.
SIZES, FEATURES, STEPS, RATE, DECAY, MOST_LABELLED, MOST_RULES = (3, 4), 1024, 80, 4.0, 0.002, 5000, 1000

#: Groups of features in which their places are looked up.
GROUPS = 32

#: Fixed values: (rule, verdict). A rule is a host, which stands for its subdomains too, and the start of a path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

#: Fixed values, from which the labelled URLs are made: words of wanted and of unwanted sites, syllables of names that say
#: nothing, forms of both kinds ({w}, {v}: words; {s}: a name; {l}: a language; {n}: a number), endings and languages.
WANTED = (
    "library", "museum", "garden", "physics", "history", "weather", "recipes", "university", "science", "school", "orchestra", "parliament",
    "archive", "medicine", "grammar", "astronomy", "birds", "travel", "maths", "painting", "chemistry", "railway", "poetry", "geology",
)
UNWANTED = (
    "casino", "poker", "viagra", "xxx", "porn", "escort", "keygen", "warez", "jackpot", "betting", "replica", "cialis",
    "sexcam", "payday", "torrent", "cracked", "nude", "slots", "backlinks", "doubler", "pills", "spam", "adult", "lottery",
)
NAMES = ("tion", "ble", "thor", "sha", "ren", "lyn", "ther", "mar", "kel", "don", "vis")
FORMS = {
    0: ("www.{w}.example.{t}/{v}/{n}", "{v}.{w}.example.{t}/{l}/article/{n}", "blog.{s}.example.{t}/{l}/{n}", "m.{s}.example.{t}/{l}/{n}/", "docs.{s}.example.{t}/guide/{w}?page={n}"),
    1: ("{w}-{v}.example.{t}/free/{n}", "www.{w}.example.{t}/{l}/{v}/{n}", "m.{s}.example.{t}/{w}/{v}-online-{n}", "{s}.example.{t}/{l}/buy-{w}?ref={n}", "hot-{w}.example.{t}/{l}/{n}"),
}
ENDINGS, LANGUAGES, EACH = ("com", "net", "org", "info"), ("en", "fr", "de", "es"), 160


def labelled(each: int = EACH) -> list[tuple[str, int]]:
    """(URL, 1: block) of `each` URLs of both kinds; languages, endings and names that say nothing are as frequent in both."""
    out = []
    for label, words in ((0, WANTED), (1, UNWANTED)):
        for i in range(each):
            name = NAMES[i % len(NAMES)] + NAMES[(5 * i + 2) % len(NAMES)]
            form = FORMS[label][i % len(FORMS[label])]
            url = form.format(w=words[i % len(words)], v=words[(7 * i + 3) % len(words)], s=name, t=ENDINGS[i // 3 % len(ENDINGS)], l=LANGUAGES[i // 5 % len(LANGUAGES)], n=1 + 37 * i % 9973)
            out.append((("https://" if i % 3 else "http://") + url, label))
    return out


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty where url is null or has no "://"."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, "(?s)^.*?://(.*)$", 1)), F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, "^[^/?#]*", ""), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct<rule, verdict>, or null. Of rules alike, the one that blocks wins."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[1] == "block")):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _chars(text: Column) -> Column:
    """The characters of a text between two marks."""
    return F.split(F.concat(F.lit("^"), text, F.lit("$")), "")


def _grams(chars: Column, kind: str) -> Column:
    """Hashed n-grams as array<int> of 1 to FEATURES. chars must be a plain column: it is read for each n-gram."""

    def of(n: int) -> Column:
        gram = lambda i: (F.pmod(F.xxhash64(F.lit(kind), *[F.get(chars, i + k) for k in range(n)]), F.lit(FEATURES)) + 1).cast("int")
        last = F.size(chars) - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), gram)).otherwise(F.array().cast("array<int>"))

    return F.concat(*[of(n) for n in SIZES])


def with_features(df: DataFrame, host: str, path: str) -> DataFrame:
    """Adds `features`, the hashed n-grams of both columns."""
    df = df.withColumns({"_host": _chars(F.col(host)), "_path": _chars(F.col(path))})
    return df.withColumn("features", F.concat(_grams(F.col("_host"), "host"), _grams(F.col("_path"), "path"))).drop("_host", "_path")


def _logit(w: Column, f: Column) -> Column:
    """Bias (last weight) plus the mean weight of the features, scaled by the root of their number."""
    total = F.aggregate(f, F.lit(0.0), lambda a, j: a + F.element_at(w, j))
    return total / F.sqrt(F.greatest(F.size(f), F.lit(1)).cast("double")) + F.element_at(w, FEATURES + 1)


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _settled(one_row: DataFrame) -> DataFrame:
    """The same single row behind an aggregate, so that its columns are not computed anew inside the next lambda."""
    return one_row.agg(*[F.first(c).alias(c) for c in one_row.columns])


def train(labelled: DataFrame) -> list[float]:
    """Weights of FEATURES hashed n-grams, then the bias.

    labelled: (url, label 0 or 1), MOST_LABELLED rows at most; rows with a null in either take no part, and neither does a
    URL with no host and path. Order does not matter. Without rows all weights are 0.
    """
    host, path = split_url(F.col("url"))
    rows = labelled.where("url is not null and label is not null").select(F.col("label").cast("double").alias("y"), host.alias("host"), path.alias("path"), "url")
    rows = with_features(rows.where("host <> '' or path <> ''"), "host", "path").select("url", "y", F.col("features").alias("f"))
    if rows.limit(MOST_LABELLED + 1).count() > MOST_LABELLED:
        raise ValueError(f"at most {MOST_LABELLED} labelled URLs")
    table = rows.agg(F.array_sort(F.collect_list(F.struct("url", "y", "f"))).alias("rows"))
    n = F.greatest(F.size("rows"), F.lit(1)).cast("double")
    #: Where each feature occurs: a row's index as often as the feature occurs in it.
    where = F.aggregate(
        F.transform("rows", lambda r, i: F.transform(r["f"], lambda j: F.struct(j.alias("j"), i.alias("i")))),
        F.array().cast("array<struct<j:int,i:int>>"), lambda a, x: F.concat(a, x),
    )
    zero = F.transform(F.sequence(F.lit(1), F.lit(FEATURES + 1)), lambda _: F.lit(0.0))
    table = _settled(table.select("rows", n.alias("n"), where.alias("pairs"), zero.alias("zero")))
    # By groups of features first, so that not every feature goes through all pairs.
    groups = F.transform(F.sequence(F.lit(0), F.lit(GROUPS - 1)), lambda g: F.filter("pairs", lambda p: p["j"] % GROUPS == g))
    table = _settled(table.select("rows", "n", "zero", groups.alias("groups")))
    inverse = F.transform("zero", lambda _, j: F.filter(F.get("groups", (j + 1) % GROUPS), lambda p: p["j"] == j + 1)["i"])
    table = _settled(table.select("rows", "n", "zero", inverse.alias("inverse")))
    start = F.struct(F.col("zero").alias("w"), F.array().cast("array<double>").alias("g"))

    def step(s: Column, k: Column) -> Column:
        """By turns: the rows' errors under the weights, then new weights from these errors."""
        errors = F.transform("rows", lambda r: (_sigmoid(_logit(s["w"], r["f"])) - r["y"]) / F.col("n"))
        scaled = lambda i: F.get(s["g"], i) / F.sqrt(F.greatest(F.size(F.get("rows", i)["f"]), F.lit(1)).cast("double"))
        moved = F.transform(s["w"], lambda w, j: F.when(j == FEATURES, w - RATE * F.aggregate(s["g"], F.lit(0.0), lambda a, e: a + e)).otherwise(w * (1 - RATE * DECAY) - RATE * F.aggregate(F.get("inverse", j), F.lit(0.0), lambda a, i: a + scaled(i))))
        odd = k % 2 == 1
        return F.struct(F.when(odd, s["w"]).otherwise(moved).alias("w"), F.when(odd, errors).otherwise(s["g"]).alias("g"))

    fitted = table.select(F.aggregate(F.sequence(F.lit(1), F.lit(2 * STEPS)), start, step)["w"].alias("w"))
    return list(fitted.first()["w"])


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.sql("select * from values " + ", ".join(f"('{u}', {y})" for u, y in labelled()) + " as t(url, label)")


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict (allow or block) and score (the model's probability of block) of every row.

    A null URL, or one without "://", has an empty host and path; no rule fits it and the model judges its bias and end
    marks. Repeated rows are judged each. Columns besides id and URL are ignored.
    """
    weights = F.split(F.lit(",".join(map(repr, train(labelled)))), ",").cast("array<double>")
    host, path = split_url(F.col(url_col))
    out = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    out = with_features(out, "host", "path").withColumns({"best": best_rule(F.col("host"), F.col("path"), rules), "score": _sigmoid(_logit(weights, F.col("features")))})
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), by_model).alias("verdict"), "score")
