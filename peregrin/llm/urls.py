"""URL filters: rules, and a naive Bayes score over segmented host and path words.

Rules come first: a rule fits its host and all subdomains if the path starts
with the rule's path, and the longest fitting rule decides. For other urls the
labels of host and path are segmented by a unigram Viterbi pass, which finds the
split of greatest probability (letters of no word cost more for each), and a
multinomial naive Bayes model scores the words.

Both models are learnt from the table. Word frequencies come from the texts of
all pages. The classifier learns from the urls that the rules decide, without
the words that the rules themselves test, since those only repeat the rule. A
rule judges a site, and says nothing of a word that only this site has: so a
word counts once for each site (the last two labels of a host) and verdict, and
a page is scored by counts that leave its own site out. Sites are dealt into 64
folds, and the counts of a fold are subtracted for its own pages. The labelled
names below count as half as much evidence as all sites. Words rarer than one in
100,000 are left out of either model, so neither has more entries than that,
whatever the table's size; the lexicon has words of 2 to 24 letters of a-z, as
only such letters of a url are split into words.
"""

from __future__ import annotations

import math
import re
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialise

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Labelled names from which the classifier learns; parameters of the operator.
BLOCK_NAMES = (
    "adult videos clips", "free adult cams", "hot sex chat", "xxx porn tube", "nude girls live", "adult dating now", "casino bet win", "online casino bonus", "poker slots jackpot", "sports bet odds",
    "ads track click", "ad server banner", "click track pixel", "popup ads network", "tracker pixel beacon", "spam mail bulk", "spam link farm", "cheap pills pharma", "viagra pills shop", "free download crack keygen", "warez torrent crack",
    "malware phish login", "phish bank verify", "get rich quick money", "payday loan cash fast", "escort girls adult",
)
ALLOW_NAMES = (
    "news daily world", "blog travel food", "wiki library open", "forum help support", "school science math", "city museum history", "health doctor care", "garden home kitchen", "weather map local", "music book film",
    "page index start", "docs guide manual", "university research paper", "recipe cook bread", "sport football club", "photo art design", "mail web office", "mobile site phone", "shop store market", "family child play",
    "article story post", "about contact team", "code open source", "job work office", "train bus travel",
)
PRIOR_BLOCK = 0.3
#: Least share of all words that a word of the lexicon, and of the classifier, has; longest word of the lexicon.
LEAST_SHARE, LONGEST = 1e-5, 24
#: Evidence of the labelled names, as a part of what the decided sites give.
NAMES_PART = 0.5
#: Added to a word's sites of either verdict: so one site alone weighs less than the prior.
SMOOTHING = 1.0
#: Parts that sites are dealt into; a page is scored without its own site's part.
FOLDS = 64


def _named(names) -> dict[str, int]:
    counts: dict[str, int] = {}
    for w in (w for name in names for w in name.split()):
        counts[w] = counts.get(w, 0) + 1
    return counts


class UrlModel:
    """A lexicon (word -> times) and a classifier (word -> sites that are blocked and allowed with it; sites of either verdict)."""

    def __init__(self, lexicon: dict[str, int] | None = None, decided: dict[str, tuple[int, int]] | None = None, urls: tuple[int, int] = (0, 0), *, block=BLOCK_NAMES, allow=ALLOW_NAMES, prior_block: float = PRIOR_BLOCK, names_part: float = NAMES_PART, smoothing: float = SMOOTHING):
        named = (_named(block), _named(allow))
        total = sum((lexicon or {}).values())
        times = {w: max(1.0, LEAST_SHARE * total) * sum(c.get(w, 0) for c in named) for w in {*named[0], *named[1]}}
        for w, n in (lexicon or {}).items():
            times[w] = max(n, times.get(w, 0))
        everything = sum(times.values())
        self.logp = {w: math.log(n / everything) for w, n in times.items()}
        self.unknown = math.log(1 / everything)
        self.longest = max(map(len, times))
        self.learn(named, decided or {}, urls, prior_block, names_part, smoothing)

    def learn(self, named, decided: dict, urls: tuple[int, int], prior_block: float = PRIOR_BLOCK, names_part: float = NAMES_PART, smoothing: float = SMOOTHING) -> None:
        seen = sum(a + b for a, b in decided.values())
        each = max(1.0, names_part * seen / max(1, sum(sum(c.values()) for c in named)))
        words = {*named[0], *named[1], *decided}
        counts = [{w: each * c.get(w, 0) + decided.get(w, (0, 0))[k] for w in words} for k, c in enumerate(named)]
        total = [sum(c.values()) + smoothing * len(words) for c in counts]
        self.weight = {w: math.log((counts[0][w] + smoothing) / total[0]) - math.log((counts[1][w] + smoothing) / total[1]) for w in words}
        blocked = (urls[0] + 100 * prior_block) / (sum(urls) + 100)
        self.prior = math.log(blocked / (1 - blocked))

    def segment(self, name: str) -> list[str]:
        """The likeliest words of a name; letters of no word stay together.

        A run of n unknown letters costs unknown - n * log(10), so that it is
        cheaper whole than in parts.
        """
        n = len(name)
        best = [0.0] + [-math.inf] * n
        back: list[tuple[int, bool]] = [(0, False)] * (n + 1)
        run = [-math.inf] * (n + 1)
        start = [0] * (n + 1)
        letter = math.log(10)
        for i in range(1, n + 1):
            opened, going = best[i - 1] + self.unknown - letter, run[i - 1] - letter
            run[i], start[i] = (going, start[i - 1]) if going >= opened else (opened, i - 1)
            best[i], back[i] = run[i], (start[i], False)
            for a in range(max(0, i - self.longest), i):
                p = self.logp.get(name[a:i])
                if p is not None and best[a] + p > best[i]:
                    best[i], back[i] = best[a] + p, (a, True)
        out, i = [], n
        while i:
            a = back[i][0]
            out.append(name[a:i])
            i = a
        return out[::-1]


def probability(z: float) -> float:
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = re.search("[/?#]", rest)
    host = rest[: end.start()] if end else rest
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), path


def fitting_rule(host: str, path: str, rules: dict) -> tuple[str, str] | None:
    """The longest fitting rule's text and verdict. rules: host -> [(path, verdict)]."""
    best = None
    while True:
        for start, verdict in rules.get(host, ()):
            if path.startswith(start) and (best is None or len(host + start) > len(best[0])):
                best = (host + start, verdict)
        if "." not in host:
            return best
        host = host.split(".", 1)[1]


def word_counts(pages: DataFrame, html_col: str = "html") -> dict[str, int]:
    """How often each frequent word of a-z stands in the texts of all pages; fewer words than 1 / LEAST_SHARE."""
    words = pages.select(F.explode(F.split(F.regexp_replace(F.lower(F.col(html_col)), "<[^>]*>", " "), r"[^\p{L}]+")).alias("w")).where(F.length("w").between(2, LONGEST) & F.col("w").rlike("^[a-z]+$"))
    counts = materialise(words.groupBy("w").agg(F.count("*").alias("n")), "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return {r.w: r.n for r in counts.where(F.col("n") >= LEAST_SHARE * F.lit(total)).collect()}


def site_of(host: str) -> str:
    return ".".join(host.rsplit(".", 2)[-2:])


def fold_of(site: str) -> int:
    return zlib.crc32(site.encode()) % FOLDS


class Evidence:
    """Sites of either verdict by word, as (fold, blocked, allowed) rows, and sites of either verdict by fold."""

    def __init__(self, words: dict[str, list[tuple[int, int, int]]], sites: dict[int, tuple[int, int]]):
        self.words, self.sites = words, sites

    def without(self, fold: int | None) -> tuple[dict[str, tuple[int, int]], tuple[int, int]]:
        """Counts of all sites but those of a fold."""
        kept = {w: (sum(b for f, b, _ in rows if f != fold), sum(a for f, _, a in rows if f != fold)) for w, rows in self.words.items()}
        return {w: c for w, c in kept.items() if any(c)}, tuple(sum(c[i] for f, c in self.sites.items() if f != fold) for i in (0, 1))


def decided_evidence(found: DataFrame, rules: tuple) -> Evidence:
    """From the urls that rules decide, without the rules' own words and single letters."""
    own = sorted({w for host, path, _ in rules for w in re.findall("[a-z]+", f"{host} {path}".lower())})
    ruled = found.where("rule is not null")
    count = lambda v: F.count_if(F.col("verdict") == v)
    seen = ruled.select("site", "fold", "verdict", F.explode("words").alias("w")).where(~F.col("w").isin(own) & (F.length("w") > 1)).distinct()
    words = materialise(seen.groupBy("w", "fold").agg(count("block").alias("b"), count("allow").alias("a")), "decided")
    total = words.agg(F.coalesce(F.sum(F.col("a") + F.col("b")), F.lit(0))).first()[0]
    frequent = words.groupBy("w").agg(F.sum(F.col("a") + F.col("b")).alias("n"), F.collect_list(F.struct("fold", "b", "a")).alias("rows")).where(F.col("n") >= LEAST_SHARE * F.lit(total))
    sites = ruled.select("site", "fold", "verdict").distinct().groupBy("fold").agg(count("block").alias("b"), count("allow").alias("a"))
    return Evidence({r.w: [tuple(x) for x in r.rows] for r in frequent.collect()}, {r.fold: (r.b, r.a) for r in sites.collect()})


def judge_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple = RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, words, score, fold for each row.

    A null url, or one without `://`, has an empty host and path, fits no rule
    and is scored by the prior alone. Empty tables give no rows, repeated rows
    are judged each; of rules with equal texts the first counts. Where pages has
    no column html_col, the lexicon is that of the labelled names. score is the
    model's, also where a rule decides, and comes from other sites than the page's
    own: see held_out_accuracy.
    """
    model = UrlModel(word_counts(pages, html_col) if html_col in pages.columns else None)
    by_host: dict[str, list] = {}
    for host, path, verdict in rules:
        by_host.setdefault(host, []).append((path, verdict))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def split(batches):
        segment = lru_cache(100_000)(lambda label: tuple(shared.value.segment(label)))
        words_in = re.compile("[a-z]+").findall
        for batch in batches:
            out = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule = fitting_rule(host, path, by_host) or (None, None)
                site = site_of(host)
                out.append((host, path, *rule, [w for label in words_in(host) + words_in(path.lower()) for w in segment(label)], site, fold_of(site)))
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], names=["page_id", "host", "path", "rule", "verdict", "words", "site", "fold"])

    kind = pages.schema[id_col].dataType.simpleString()
    columns = f"page_id {kind}, host string, path string, rule string, verdict string, words array<string>"
    found = materialise(pages.select(F.col(id_col).alias("page_id"), url_col).mapInArrow(split, f"{columns}, site string, fold int"), "urls")
    scorer = pages.sparkSession.sparkContext.broadcast(decided_evidence(found, rules))

    def score(batches):
        evidence, named = scorer.value, (_named(BLOCK_NAMES), _named(ALLOW_NAMES))

        @lru_cache(FOLDS)
        def model_without(fold: int) -> tuple[dict[str, float], float]:
            model = UrlModel()
            model.learn(named, *evidence.without(fold if fold in evidence.sites else None))
            return model.weight, model.prior

        for batch in batches:
            scores = []
            for words, fold in zip(batch.column(5).to_pylist(), batch.column(7).to_pylist(), strict=True):
                weight, prior = model_without(fold if fold in evidence.sites else -1)
                scores.append(probability(prior + sum(weight.get(w, 0.0) for w in words)))
            verdicts = [v or ("block" if p >= threshold else "allow") for v, p in zip(batch.column(4).to_pylist(), scores, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(verdicts, pa.string()), batch.column(5), pa.array(scores, pa.float64()), batch.column(7)], names=[*batch.schema.names[:6], "score", "fold"])

    return materialise(found.mapInArrow(score, f"{columns}, score double, fold int"), "judged")


def held_out_accuracy(judged: DataFrame, threshold: float = 0.5) -> DataFrame:
    """site, pages, right, prior_right: of the pages that rules decide, how many the model, which hasn't seen their site, judges as the rule does, and how many the share of blocked names alone would."""
    right = lambda says: F.count_if(F.col("verdict") == F.when(says, "block").otherwise("allow"))
    site = F.regexp_extract("host", r"([^.]*\.)?[^.]*$", 0).alias("site")
    return judged.where("rule is not null").groupBy(site).agg(F.count("*").alias("pages"), right(F.col("score") >= threshold).alias("right"), right(F.lit(PRIOR_BLOCK >= threshold)).alias("prior_right"))
