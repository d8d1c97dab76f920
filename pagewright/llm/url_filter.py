"""URL filters in DataFrame functions only: rules by host and path first, then a logistic regression.

The model sees hashed character n-grams of host and path and is trained from a small labelled URL table, whose size is a
documented parameter (MOST_LABELLED rows, for the weights are fitted by passes over it). Training is full-batch gradient
descent with momentum in one job: the table's n-grams, bounded by it, become two arrays of one row (the buckets of each url, the urls of each bucket),
over which an aggregate makes the passes. The weights, one per bucket, reach the driver and are constants in the plan that judges.
What the model carries over to sites whose subject it hasn't seen is what unwanted sites share: words that lure, how names are put together, endings and paths.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the model like
any other (an empty url has no n-grams: the bias alone decides). Repeated rows are judged one by one; of rules of one length the first in
alphabetical order wins; an empty table gives an empty result; extra columns are ignored. Without labelled rows all weights are 0, and the model blocks.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import hidden

#: (verdict, host/path) of the production rules.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Labelled rows that training takes at most; beyond it ``train`` refuses.
MOST_LABELLED = 5000
BUCKETS = 1 << 14
SIZES = (3, 4, 5)
PASSES = 60
RATE = 10.0
#: What is kept of a pass's step in the next.
MOMENTUM = 0.9

_HOST, _PATH, _GRAMS, _FITS = (hidden(x) for x in ("host", "path", "grams", "fits"))

#: Words of the small labelled table's hosts: what unwanted and wanted sites are about, what both kinds put beside it, and syllables, two of which make a name such as most sites have: it says nothing, and the
#: site is wanted. Wanted sites are in the majority, as in a crawl.
_BAD_WORDS = """casino poker betting xxx porn escort viagra pills torrent warez crack jackpot payday replica clickbait malware slots roulette gambling webcam
hookup sexchat nudes keygen phishing cialis bingo sportsbook spyware fakeid loans lottery steroids pharmacy serialkeys bitcoin forex followers ringtones tracker popup adware spam
dating singles diploma watches handbags weightloss enlargement blackjack baccarat tramadol xanax milf hentai doubler giveaway survey""".split()
_GOOD_WORDS = """library archive science museum school journal wiki recipes history health research garden weather council physics courses university hospital theatre
railway harbour forest bakery orchestra cinema village farming geology cycling chess painting language grammar atlas travel mountain pottery hiking software printer
furniture election newspaper astronomy football knitting camera kitchen dentist insurance airport charity parliament biology mathematics carpenter fishing sailing
novels radio""".split()
_LURES = "free best cheap hot win live bonus online deals vip top fast instant 24 max super real club hub zone".split()
_PLAIN = "city national public old north open local county royal little central modern west river green family young first society institute".split()
_SYLLABLES = "an ber co da el fen gar her in jo kel lan mar nor on per qui ran sen tor um ver win xan yel zo ther ing tion and ble ess".split()
#: w and v are words of one kind, a and b what stands beside them, l a lure at a wanted site. Neither hyphens nor most paths give a kind away.
_BAD_HOSTS = (
    "{a}-{w}.com", "{w}-{a}.net", "{w}-{a}.example.org", "{a}{w}.info", "{w}{a}.org", "{a}-{w}-{b}.xyz", "{a}-{w}.example.net", "{w}-{a}.top", "{a}-{w}.example.com", "{w}-{b}.de", "{b}{w}.com", "{w}.bet", "{w}house.com",
    "{a}-{w}-{v}.example.net", "{v}{w}-{a}.org",
)
_GOOD_HOSTS = (
    "{w}.org", "{a}-{w}.com", "{w}.example.net", "{a}{w}.org", "{w}-{a}.de", "{a}-{w}.gov", "{w}{a}.net", "{w}.example.org", "my{w}.info", "{w}.{a}.edu", "{a}-{w}.example.org", "{w}world.co.uk", "{l}-{w}.org",
    "{w}-{v}.example.net", "{w}{l}.com",
)
_NAMES = ("{}.com", "{}.example.net", "{}.org", "{}.example.org", "{}.info", "{}.de", "{}.example.com", "{}24.net")
_BEFORE = ("", "www.", "m.", "blog.")
_PATHS = ("/", "", "/en/{}", "/de/{}.html", "/fr/{}/", "/index.php", "/page/{}", "/2021/{}/item", "/list/all", "/es/{}", "/about-us", "/download/{}", "/view/{}/", "/en/{}/", "/t/{}")
_BAD_PATHS = ("/free-{}", "/claim/{}", "/signup?aff={}", "/order-now/{}", "/play/{}", "/join", "/bonus/{}", "/go.php?id={}", "/deals/{}")
#: Words of a kind are dealt out to so many groups: an url's words are of one, so that groups can be left out of training.
WORD_GROUPS = 5


def labelled_rows() -> list[tuple[str, int, int]]:
    """(url, label, group): a label is 1 for unwanted ones."""

    def url(i: int, j: int, host: str, paths: tuple[str, ...]) -> str:
        return f"https://{_BEFORE[(i + j) % 4]}{host}{paths[(7 * i + j) % len(paths)].format((i * 7919 + j * 10007) % 60000)}"

    rows = []
    for label, words, beside, hosts in ((1, _BAD_WORDS, _LURES, _BAD_HOSTS), (0, _GOOD_WORDS, _PLAIN, _GOOD_HOSTS)):
        whole = len(words) - len(words) % WORD_GROUPS
        for i, word in enumerate(words):
            for j, host in enumerate(hosts):
                a, b = beside[(5 * i + 7 * j) % len(beside)], beside[(3 * i + 11 * j + 1) % len(beside)]
                named = host.format(w=word, a=a, b=b, v=words[(i + WORD_GROUPS) % whole], l=_LURES[(5 * i + 3 * j) % len(_LURES)])
                rows.append((url(i, j, named, _BAD_PATHS if label and (i + j) % 5 < 2 else _PATHS), label, i % WORD_GROUPS))
    n = len(_SYLLABLES)
    names = [_SYLLABLES[i] + _SYLLABLES[(i + step) % n] for step in (1, 5, 11, 19, 27) for i in range(n)]
    rows += [(url(i, j, _NAMES[(i + 3 * j) % len(_NAMES)].format(name), _PATHS), 0, i % WORD_GROUPS) for i, name in enumerate(names) for j in range(4)]
    return rows


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table: url, label."""
    return spark.createDataFrame([(url, label) for url, label, _ in labelled_rows()], "url string, label int")


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next / ? # or the end; A-Z in lower case."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/?[^?#]*)", 1), F.lit(""))


def _with_parts(frame: DataFrame, url: str) -> DataFrame:
    return frame.withColumns({_HOST: host_of(F.col(url)), _PATH: path_of(F.col(url))})


def grams(size: int = BUCKETS, sizes: Sequence[int] = SIZES) -> Column:
    """Distinct buckets of the character n-grams of host and path, each marked by the part it is from."""

    def of(part: Column, mark: str, n: int) -> Column:
        marked = F.concat(F.lit(mark), part, F.lit("$"))
        at = F.sequence(F.lit(1), F.length(marked) - (n - 1))
        made = F.transform(at, lambda i: F.pmod(F.xxhash64(F.lit(mark), marked.substr(i, F.lit(n))), F.lit(size)).cast("int"))
        return F.when((part != "") & (F.length(marked) >= n), made).otherwise(F.array().cast("array<int>"))

    return F.array_distinct(F.flatten(F.array(*(of(F.col(c), m, n) for c, m in ((_HOST, "^"), (_PATH, "/")) for n in sizes))))


def rule_of(rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule whose host is the url's or a parent of it and whose path begins the url's; null if none. Rules are a parameter, in the plan."""
    found = None
    for _, rule in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        host, slash, path = rule.partition("/")
        fits = ((F.col(_HOST) == host) | F.endswith(F.col(_HOST), F.lit(f".{host}"))) & F.startswith(F.col(_PATH), F.lit(slash + path))
        found = F.when(fits, F.lit(rule)) if found is None else found.when(fits, F.lit(rule))
    return F.lit(None).cast("string") if found is None else found


def _score(weights: Sequence[float], bias: float) -> Column:
    """Sum of the weights of the buckets, scaled by the root of their number, plus the bias. The weights are a constant in the plan."""
    table = F.from_json(F.lit(json.dumps(list(weights))), "array<double>")
    total = F.aggregate(_GRAMS, F.lit(0.0), lambda acc, b: acc + F.get(table, b))
    return total / F.sqrt(F.greatest(F.size(_GRAMS), F.lit(1))) + F.lit(bias)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def train(labelled: DataFrame, passes: int = PASSES, rate: float = RATE) -> tuple[list[float], float]:
    """labelled: url, label (1 for block). Weights and bias, rounded to 9 digits so that the order of sums doesn't show."""
    frame = _with_parts(labelled.filter(F.col("url").isNotNull() & F.col("label").isNotNull()), "url")
    # one more than allowed is enough to see that there are too many
    known = frame.select(F.col("label").cast("double").alias("label"), F.array_sort(grams()).alias(_GRAMS)).limit(MOST_LABELLED + 1)
    urls = known.agg(F.array_sort(F.collect_list(F.struct("label", _GRAMS))).alias("urls"))
    entries = urls.select(F.posexplode("urls").alias("i", "url")).select("i", F.explode(F.col("url")[_GRAMS]).alias("bucket"))
    every = labelled.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    inverted = every.join(entries, "bucket", "left").groupBy("bucket").agg(F.array_sort(F.collect_list("i")).alias("of")).agg(F.array_sort(F.collect_list(F.struct("bucket", "of"))).alias("of"))
    both = urls.unionByName(inverted, allowMissingColumns=True).agg(F.first("urls", ignorenulls=True).alias("urls"), F.first("of", ignorenulls=True).alias("of"))
    placed = both.select(
        F.transform("urls", lambda u: u["label"]).alias("labels"),
        F.transform("urls", lambda u: u[_GRAMS]).alias("grams"),
        F.transform("urls", lambda u: F.sqrt(F.greatest(F.size(u[_GRAMS]), F.lit(1)))).alias("roots"),
        F.transform("of", lambda b: b["of"]).alias("of"),
    )
    n = F.size("labels")

    def step(state: Column, _: Column) -> Column:
        def score(g: Column, root: Column) -> Column:
            return F.aggregate(g, F.lit(0.0), lambda total, b: total + F.get(state["weights"], b)) / root + state["bias"]

        errors = F.transform("labels", lambda y, i: y - F.lit(1.0) / (F.lit(1.0) + F.exp(-score(F.get("grams", i), F.get("roots", i)))))

        def moved(e: Column) -> Column:
            gains = F.transform("of", lambda of: _sum(F.transform(of, lambda i: F.get(e, i) / F.get("roots", i))) * F.lit(rate * len(SIZES)) / n)
            pushes = F.transform(gains, lambda gain, k: F.round(F.get(state["pushes"], k) * MOMENTUM + gain, 9))
            push = F.round(state["push"] * MOMENTUM + _sum(e) * F.lit(rate) / n, 9)

            def after(p: Column) -> Column:
                weights = F.transform(state["weights"], lambda w, k: F.round(w + F.get(p, k), 9))
                return F.struct(weights.alias("weights"), p.alias("pushes"), F.round(state["bias"] + push, 9).alias("bias"), push.alias("push"))

            return _bound(pushes, after)

        return _bound(errors, moved)

    none = F.array_repeat(F.lit(0.0), BUCKETS)
    start = F.struct(none.alias("weights"), none.alias("pushes"), F.lit(0.0).alias("bias"), F.lit(0.0).alias("push"))
    model = F.when(n.between(1, MOST_LABELLED), F.aggregate(F.sequence(F.lit(1), F.lit(passes)), start, step)).otherwise(start)
    fitted = placed.select(n.alias("n"), model.alias("model")).first()  # one row of BUCKETS weights
    if fitted.n > MOST_LABELLED:
        raise ValueError(f"more than {MOST_LABELLED} labelled urls")
    return fitted.model.weights, fitted.model.bias


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict (the rule's, else block where the score is at least one half), score (the model's, from 0 to 1)."""
    weights, bias = train(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    frame = _with_parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")), "url")
    ruled = frame.select("page_id", F.col(_HOST).alias("host"), F.col(_PATH).alias("path"), rule_of(rules).alias("rule"), grams().alias(_GRAMS))
    blocked = [rule for verdict, rule in rules if verdict == "block"]
    ruled = ruled.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-_score(weights, bias))))
    own = F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    verdict = F.when(F.col("rule").isNull(), own).when(F.col("rule").isin(blocked), F.lit("block")).otherwise(F.lit("allow"))
    return ruled.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
