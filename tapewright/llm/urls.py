"""URL filters: host and path rules, then a weighted vocabulary matched by Aho-Corasick."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (rule, verdict); of the rules that fit the longest decides.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: One of these in a url rejects it.
STRICT = (
    "bdsm", "blowjob", "camgirl", "camgirls", "casino", "casinos", "cialis", "cumshot", "escort", "escorts", "fetish", "gangbang", "hardcore", "hentai", "milf", "onlyfans",
    "porn", "porno", "pornhub", "viagra", "warez", "webcamsex", "xvideos", "xxx",
)
#: Each adds its weight once; with ``SOFT_LIMIT`` in all, which takes two terms or more, they reject a url.
SOFT = {
    "adult": 2, "betting": 2, "erotic": 2, "gambling": 2, "jackpot": 2, "keygen": 2, "lottery": 2, "nude": 2, "payday": 2, "pills": 2, "poker": 2, "replica": 2, "serialz": 2,
    "sex": 2, "sexy": 2, "slots": 2, "steroids": 2, "torrent": 2,
    "bet": 1, "bonus": 1, "cam": 1, "cheap": 1, "crack": 1, "credit": 1, "dating": 1, "deal": 1, "diet": 1, "discount": 1, "free": 1, "girls": 1, "hack": 1, "hot": 1, "loan": 1,
    "loans": 1, "nulled": 1, "odds": 1, "pharmacy": 1, "promo": 1, "rolex": 1, "singles": 1, "spins": 1, "win": 1,
}
SOFT_LIMIT = 3


def load_vocabulary(path: str) -> tuple[tuple[str, ...], dict[str, int]]:
    """Strict terms and soft ones with weights from a file of lines ``term<tab>weight``; the weight of a strict term is ``strict``."""
    strict, soft = [], {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            term, _, weight = line.strip().partition("\t")
            if term and weight == "strict":
                strict.append(term)
            elif term and not term.startswith("#"):
                soft[term] = int(weight)
    return tuple(strict), soft


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Iterable[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The rule that decides and its verdict, or nulls.

    A rule fits its host and all subdomains, where the path starts with the rule's.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


@lru_cache(maxsize=4)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    """Aho-Corasick automaton over both vocabularies; its values are (number, strict or not, term)."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for term, is_strict in [*((t, False) for t in soft), *((t, True) for t in strict)]:
        found.add_word(term, (is_strict, term))
    found.make_automaton()
    return found


def _alnum(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def found_terms(url: str | None, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = tuple(SOFT)) -> set[tuple[bool, str]]:
    """Distinct terms that stand alone, no ASCII letter or digit beside them, and whether they are strict."""
    text = "".join([c.lower() if "A" <= c <= "Z" else c for c in url or ""])
    seen = set()
    for end, (is_strict, term) in automaton(tuple(strict), tuple(soft)).iter(text):
        start = end - len(term) + 1
        if not (start and _alnum(text[start - 1])) and not (end + 1 < len(text) and _alnum(text[end + 1])):
            seen.add((is_strict, term))
    return seen


def count_terms(url: str | None, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = tuple(SOFT)) -> tuple[int, int]:
    """How many distinct strict and soft terms a url has."""
    seen = found_terms(url, strict, soft)
    return sum(s for s, _ in seen), sum(not s for s, _ in seen)


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Iterable[tuple[str, str]] = RULES, strict: tuple[str, ...] = STRICT, soft: dict[str, int] | None = None, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """For every row: ``<id_col>, host, path, rule, verdict, n_strict, n_soft, soft_weight``.

    The verdict is the longest fitting rule's; without one it is ``block`` for
    one strict term, or for two distinct soft ones or more whose weights add up to
    ``soft_limit``, and ``allow`` otherwise. A null url, or one without ``://``, has
    an empty host and path; its terms count like any other's. Ids may be null;
    repeated rows are judged alike, and rules of one length by name. Urls may be of
    any length. Each row is judged by itself, with one pass over the url whatever
    the size of the vocabulary; nothing is shuffled. Other columns are not looked
    at; an empty table gives an empty result.
    """
    weights = dict(SOFT if soft is None else soft)
    words = tuple(weights)

    @F.pandas_udf("n_strict long, n_soft long, soft_weight long")
    def terms(url):
        import pandas as pd

        def one(u):
            seen = found_terms(u, strict, words)
            hits = [t for s, t in seen if not s]
            return len(seen) - len(hits), len(hits), sum(weights[t] for t in hits)

        return pd.DataFrame([one(u) for u in url], columns=["n_strict", "n_soft", "soft_weight"], dtype="int64")

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rows = rows.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), terms("url").alias("t"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), tuple(rules))
    several = (F.col("t.n_soft") >= 2) & (F.col("t.soft_weight") >= soft_limit)
    method = F.when((F.col("t.n_strict") >= 1) | several, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "t.n_strict", "t.n_soft", "t.soft_weight")


def _quoted(terms: Iterable[str]) -> str:
    return ", ".join(f"'{t}'" for t in terms)


def oracle() -> str:
    """The same in DuckDB's SQL: a pattern for each term in place of the automaton."""
    rules = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
    fits = {r: "((host = '{0}' OR suffix(host, '.{0}')) AND starts_with(path, '/{1}'))".format(*r.split("/", 1)) for r, _ in rules}
    alone = "lambda x: regexp_matches(lowered, '(^|[^a-z0-9])' || x || '($|[^a-z0-9])')"
    by_weight = {w: [t for t in SOFT if SOFT[t] == w] for w in sorted(set(SOFT.values()))}
    weights = " + ".join(f"{w} * len(list_filter([{_quoted(terms)}], {alone}))" for w, terms in by_weight.items())
    return f"""
        WITH parts AS (
            SELECT page_id,
                   coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '') AS raw,
                   coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
                   translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered
            FROM pages),
        named AS (
            SELECT page_id, path,
                   translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   len(list_filter([{_quoted(STRICT)}], {alone})) AS n_strict,
                   len(list_filter([{_quoted(SOFT)}], {alone})) AS n_soft,
                   coalesce({weights}, 0) AS soft_weight
            FROM parts)
        SELECT page_id, host, path,
               CASE {" ".join(f"WHEN {fits[r]} THEN '{r}'" for r, _ in rules)} END AS rule,
               CASE {" ".join(f"WHEN {fits[r]} THEN '{v}'" for r, v in rules)}
                    WHEN n_strict >= 1 OR (n_soft >= 2 AND soft_weight >= {SOFT_LIMIT}) THEN 'block' ELSE 'allow' END AS verdict,
               n_strict, n_soft, soft_weight
        FROM named"""
