"""URL filtering with a weighted vocabulary, found by an Aho-Corasick automaton.

Site rules come first; where none fits, the vocabulary decides: a url goes if the
distinct terms it holds between boundaries weigh enough together.  A strict term
weighs enough alone, soft terms do so with others.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from ._common import add_columns

#: What terms must weigh together for a url to go.
LIMIT = 4
#: Default vocabulary of adult, gambling, piracy and drug terms in English, German, French and Spanish, in lower case.
STRICT_TERMS = (
    "porn", "porno", "pornos", "xxx", "hentai", "camgirls", "sexcam", "sexcams", "livesex", "milf", "bdsm", "hardcore-sex", "sexvideo", "sexvideos",
    "casino", "kasino", "spielautomaten", "tragaperras", "machines-a-sous", "warez", "keygen", "viagra", "cialis", "erotikchat", "putas",
)
#: Soft terms that weigh half of the limit, and a quarter.
SOFT_TERMS = (
    "adult", "betting", "cracked", "dating", "escort", "escorts", "nude", "nudes", "poker", "sexy", "slots", "torrent", "torrents",
    "erotik", "erotique", "erotica", "wetten", "gluecksspiel", "paris-sportifs", "apuestas", "ruleta", "roulette", "jackpot",
)
WEAK_TERMS = ("bonus", "chat", "free", "gratis", "gratuit", "hot", "live", "sex", "singles", "webcam", "pills", "serial", "crack")
VOCABULARY = {**dict.fromkeys(STRICT_TERMS, LIMIT), **dict.fromkeys(SOFT_TERMS, LIMIT // 2), **dict.fromkeys(WEAK_TERMS, LIMIT // 4)}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)
_INNER = frozenset(LOWER + "0123456789")


def _automaton(vocabulary: Mapping[str, int]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for term, weight in vocabulary.items():
        a.add_word(term.translate(_FOLD), (term.translate(_FOLD), weight))
    a.make_automaton()
    return a


def _rejects(automaton, url: str, limit: int) -> bool:
    """Whether the distinct terms with no letter or digit beside them weigh the limit."""
    text, seen, total = url.translate(_FOLD), set(), 0
    for end, (term, weight) in automaton.iter(text):
        before, after = end - len(term), end + 1
        if (before >= 0 and text[before] in _INNER) or (after < len(text) and text[after] in _INNER) or term in seen:
            continue
        seen.add(term)
        total += weight
        if total >= limit:
            return True
    return False


def with_url_verdict(df: DataFrame, rules: Sequence[tuple[str, str]], url_col: str = "url", vocabulary: Mapping[str, int] = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """Add host, path, rule and verdict to every row.

    vocabulary gives the weight of each term, A-Z lowered; a url without a fitting rule is blocked if its
    distinct terms, each with no ASCII letter or digit beside it, weigh the limit together.
    rules are (action, "host/path") pairs, action allow or block; a rule fits its host and
    all subdomains where the url's path starts with the rule's path.  The longest fitting
    rule wins; of equally long ones the one listed first.  Host: after the first ``://`` up
    to ``/``, ``?``, ``#`` or the end, with A-Z lowered; path: from there up to ``?``, ``#``
    or the end.  A null url, or one without ``://``, has an empty host and path and no rule;
    a null url has no terms and is allowed.  Rows stay as they are, repeated ones too; an
    empty table gives an empty result; columns called like the four new ones are replaced.
    """
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for action, rule in sorted(rules, key=lambda x: -len(x[1])):
        host, slash, path = rule.partition("/")
        by_host.setdefault(host.translate(_FOLD), []).append((slash + path, rule, action))

    def make():
        automaton = _automaton(vocabulary) if vocabulary else None

        def judge(url: str | None) -> tuple[str, str, str | None, str]:
            host = path = ""
            if url is not None and (at := url.find("://")) >= 0:
                rest = url[at + 3 :]
                cut = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
                rest = rest[:cut]
                slash = rest.find("/")
                host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
                host = host.translate(_FOLD)
            best = None
            suffix = host
            while True:
                for own_path, rule, action in by_host.get(suffix, ()):
                    if path.startswith(own_path) and host and (best is None or len(rule) > len(best[0])):
                        best = (rule, action)
                        break
                dot = suffix.find(".")
                if dot < 0:
                    break
                suffix = suffix[dot + 1 :]
            if best is not None:
                return host, path, best[0], best[1]
            gone = url is not None and automaton is not None and _rejects(automaton, url, limit)
            return host, path, None, "block" if gone else "allow"

        def compute(column: pa.Array) -> list[pa.Array]:
            found = [judge(u) for u in column.to_pylist()]
            return [pa.array([x[i] for x in found], pa.string()) for i in range(4)]

        return compute

    return add_columns(df, url_col, [T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")], make)


def verdict_sql(rules: Sequence[tuple[str, str]], vocabulary: Mapping[str, int] = VOCABULARY, limit: int = LIMIT) -> str:
    """The same judgement of pages.url as DuckDB SQL."""
    fits, acts = [], []
    for action, rule in sorted(rules, key=lambda x: -len(x[1])):
        host, slash, path = rule.partition("/")
        when = f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + path}')"
        fits.append(f"{when} THEN '{rule}'")
        acts.append(f"WHEN rule = '{rule}' THEN '{action}'")
    hit = lambda t: f"regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])')"
    return f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
ruled AS (SELECT *, CASE {' '.join(fits)} END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE {' '.join(acts)}
  WHEN {' + '.join(f"{w} * {hit(t)}::INT" for t, w in vocabulary.items())} >= {limit} THEN 'block'
  ELSE 'allow' END AS verdict FROM ruled"""
