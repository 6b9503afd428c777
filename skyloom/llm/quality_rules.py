"""Operator 7, quality rules by weak supervision, in DataFrame and SQL functions alone.

Twelve overlapping rules look at counts of one text; each votes good (1), bad (-1) or abstains (0). Expectation-maximisation estimates how often
rules vote bad on good texts, one rate for each rule and free, and on the kinds of bad texts: a kind has a share of all texts, a rate for each
rule of its theme (on average at least BROKEN of them call a text of the kind bad) and one rate for the other rules. A bad vote never speaks for good.
The posterior probability of a good text decides, in place of "every rule must pass": rules of a theme that agree win, and a rule that often is
alone with its bad votes loses its say.

One pass computes the counts and writes them (a few numbers a row); the vote patterns, at most 3**12 of them and in practice some hundreds,
are counted by a shuffle of partial counts; the EM iterations run inside one SQL expression over that single row, patterns in sorted
order, so that sums don't depend on tasks. Nothing is collected to the driver.

Defined cases: a null or empty text has no words and fails the base rule; equal rows get equal results; an empty table gives an empty result;
null doc_ids are kept as they are; columns of ``docs`` with the names of outputs don't clash, since features live in one struct column.
Eight-word windows and word pairs are compared by chained 64-bit hashes, within one text only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.scratch import materialize

WINDOW = 8
RULES = ("length", "symbols", "symbol_words", "bare_words", "letters", "dup_lines", "repeats", "pairs", "adjacent", "capitals", "exclaims", "word_size")
THEMES = (("length", "word_size"), ("symbols", "symbol_words", "bare_words", "letters"), ("dup_lines", "repeats", "pairs", "adjacent"), ("capitals", "exclaims"))
ITERATIONS = 25
#: First guesses: share of each kind of bad texts, rates of bad votes within a kind's theme, beyond it and on good texts; pseudo-counts for them.
KIND, WITHIN, BEYOND, ON_GOOD, PSEUDO = 0.025, 0.6, 0.05, 0.01, 20.0
BROKEN = 1.5
KEEP_AT = 0.5
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word with a symbol, and one without letter or digit; both start after white space, so that a long word is passed over once.
_SYMBOL_WORD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D#*$%&|<>{}^~=\\]*+[#*$%&|<>{}^~=\\]"
_BARE_WORD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}\p{M}\p{N}]++(?![^\x20\x09-\x0D])"


def _halves(a: Column, step: int) -> Column:
    """Hashes of runs twice as long from hashes of runs of ``step`` words; the last ones are shorter, and so unlike all others."""
    return F.zip_with(a, F.slice(a, F.lit(step + 1), F.size(a)), lambda x, y: F.xxhash64(x, y))


def with_features(docs: DataFrame, text: str = "text", into: str = "_q") -> DataFrame:
    """``docs`` and a struct column of counts, a projection without shuffle.

    Each step is a projection of its own, so that no array is computed twice.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    p = f"{into}_"
    df = docs.withColumn(p + "t", t)
    df = df.withColumn(p + "w", F.expr(rf"filter(split({p}t, '[\\x20\\x09-\\x0D]+'), w -> w != '')"))
    df = df.withColumn(p + "l", F.expr(rf"filter(split({p}t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
    df = df.withColumn(p + "h", _halves(F.expr(f"transform({p}w, w -> xxhash64(w))"), 1))
    df = df.withColumn(p + "a", F.size(p + "h") - F.size(F.array_distinct(p + "h")))
    # a window of eight words that stands twice repeats seven pairs and five runs of four, so most texts need no longer runs
    df = df.withColumn(p + "h", F.when(F.col(p + "a") >= 7, _halves(F.col(p + "h"), 2)).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn(p + "h", F.when(F.size(p + "h") - F.size(F.array_distinct(p + "h")) >= 5, _halves(F.col(p + "h"), 4)).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn(p + "d", F.size(p + "h") > F.size(F.array_distinct(p + "h")))
    s = f"sort_array(transform({p}h, (h, i) -> struct(h, i)))"
    df = df.withColumn(p + "s", F.expr(f"case when {p}d then {s} end"))
    again = f"(k > 0 and {p}s[k - 1].h = {p}s[k].h) or (k < size({p}s) - 1 and {p}s[least(k + 1, size({p}s) - 1)].h = {p}s[k].h)"
    again = again.replace(f"{p}s[k - 1]", f"{p}s[greatest(k - 1, 0)]")
    df = df.withColumn(p + "p", F.expr(f"case when {p}d then array_sort(transform(filter(sequence(0, size({p}s) - 1), k -> {again}), k -> {p}s[k].i)) end"))
    repeats = f"aggregate({p}p, named_struct('last', -{WINDOW}, 'n', 0L), (a, x) -> named_struct('last', x, 'n', a.n + least({WINDOW}, x - a.last)), a -> a.n)"
    without = lambda pattern: F.length(p + "t") - F.length(F.regexp_replace(p + "t", pattern, ""))
    df = df.withColumn(
        into,
        F.struct(
            F.size(p + "w").cast("long").alias("n_words"),
            F.length(F.array_join(p + "w", "")).cast("long").alias("word_chars"),
            without("[#*$%&|<>]+").cast("long").alias("n_symbols"),
            F.size(p + "l").cast("long").alias("n_lines"),
            (F.size(p + "l") - F.size(F.array_distinct(p + "l"))).cast("long").alias("n_dup_lines"),
            F.coalesce(F.expr(repeats), F.lit(0)).cast("long").alias("n_repeat_words"),
            F.col(p + "a").cast("long").alias("n_pairs_again"),
            F.regexp_count(p + "t", F.lit(_SYMBOL_WORD)).cast("long").alias("n_symbol_words"),
            F.regexp_count(p + "t", F.lit(_BARE_WORD)).cast("long").alias("n_bare_words"),
            without(r"[\p{L}\p{M}\p{N}]+").cast("long").alias("n_letters"),
            F.expr(f"case when size({p}w) > 1 then size(filter({p}w, (w, i) -> w = {p}w[greatest(i - 1, 0)])) - 1 else 0 end").cast("long").alias("n_adjacent"),
            without("[A-Z]+").cast("long").alias("n_capitals"),
            (F.length(p + "t") - F.length(F.replace(F.col(p + "t"), F.lit("!"), F.lit("")))).cast("long").alias("n_exclaims"),
        ),
    )
    return df.drop(*(p + x for x in "twlhadsp"))


#: (bad if, good if, else abstain); {f} is the struct of counts.
VOTES = {
    "length": ("{f}.n_words < 20", "{f}.n_words >= 40"),
    "symbols": ("10 * {f}.n_symbols > {f}.n_words", "50 * {f}.n_symbols <= {f}.n_words"),
    "symbol_words": ("5 * {f}.n_symbol_words > {f}.n_words", "50 * {f}.n_symbol_words <= {f}.n_words"),
    "bare_words": ("10 * {f}.n_bare_words > {f}.n_words", "50 * {f}.n_bare_words <= {f}.n_words"),
    "letters": ("100 * {f}.n_letters < 75 * {f}.word_chars", "100 * {f}.n_letters >= 88 * {f}.word_chars"),
    "dup_lines": ("{f}.n_dup_lines >= 3 and 10 * {f}.n_dup_lines > 3 * {f}.n_lines", "{f}.n_lines >= 2 and 20 * {f}.n_dup_lines <= {f}.n_lines"),
    "repeats": ("100 * {f}.n_repeat_words > 30 * {f}.n_words", "100 * {f}.n_repeat_words <= 10 * {f}.n_words"),
    "pairs": ("100 * {f}.n_pairs_again > 45 * {f}.n_words", "100 * {f}.n_pairs_again <= 30 * {f}.n_words"),
    "adjacent": ("5 * {f}.n_adjacent > {f}.n_words", "20 * {f}.n_adjacent <= {f}.n_words"),
    "capitals": ("100 * {f}.n_capitals > 40 * {f}.word_chars", "100 * {f}.n_capitals <= 20 * {f}.word_chars"),
    "exclaims": ("4 * {f}.n_exclaims > {f}.n_words", "50 * {f}.n_exclaims <= {f}.n_words"),
    "word_size": ("{f}.word_chars > 25 * {f}.n_words or {f}.word_chars < 2 * {f}.n_words", "{f}.word_chars <= 12 * {f}.n_words and {f}.word_chars >= 3 * {f}.n_words"),
}
BASE_FAILED = "({f}.n_words < 20 or 100 * {f}.n_repeat_words > 30 * {f}.n_words)"


def votes(f: str) -> Column:
    """Array of -1, 0 and 1, in the order of RULES."""
    return F.expr("array(" + ", ".join(f"case when {b} then -1 when {g} then 1 else 0 end" for b, g in (VOTES[r] for r in RULES)).format(f=f) + ")")


_J, _K = len(RULES), len(THEMES)


def _likelihoods(v: str, s: str) -> str:
    """Logarithms for good and each kind: share times the chance of the votes ``v``. The state ``s``: shares, then rates of bad votes, class by class."""
    return (
        f"transform(sequence(0, {_K}), k -> aggregate(sequence(0, {_J - 1}), ln({s}[k]), (o, j) -> o + case {v}[j] "
        f"when -1 then ln({s}[{_K + 1} + {_J} * k + j]) when 1 then ln(1 - {s}[{_K + 1} + {_J} * k + j]) else 0D end))"
    )


def _posterior(v: str, s: str) -> str:
    """Probabilities of good and each kind."""
    return f"transform(array({_likelihoods(v, s)}), l -> transform(array(transform(l, x -> exp(x - array_max(l)))), e -> transform(e, x -> x / aggregate(e, 0D, (a, y) -> a + y)))[0])[0]"


def em_parameters(voted: DataFrame, column: str) -> DataFrame:
    """One row with an array: the shares of good texts and of each kind of bad ones, then their rates of bad votes by rule."""
    patterns = voted.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    row = patterns.agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("ps"))  # 3 ** 12 at most
    guess = [ON_GOOD] * _J + [WITHIN if r in t else BEYOND for t in THEMES for r in RULES]
    shares = [1 - _K * KIND] + [KIND] * _K
    first = "array(" + ", ".join(f"{x}D" for x in shares + guess) + ")"
    # sums for each class: its weight, then for each rule its bad votes and all its votes
    width = 1 + 2 * _J
    add = (
        f"(a, p) -> transform(array({_posterior('p.v', 's')}), post -> zip_with(a, flatten(transform(post, r -> concat(array(p.n * r), "
        "flatten(transform(p.v, v -> array(case when v = -1 then p.n * r else 0D end, case when v != 0 then p.n * r else 0D end)))))), (x, y) -> x + y))[0]"
    )
    sums = f"aggregate(ps, array_repeat(0D, {width * (_K + 1)}), {add})"
    total = " + ".join(f"c[{width * k}]" for k in range(_K + 1))
    new_shares = [f"(c[{width * k}] + {PSEUDO * x}D) / ({total} + {PSEUDO}D)" for k, x in enumerate(shares)]

    def rate(k: int, rules: list[int], start: float) -> str:
        hit, said = (" + ".join(f"c[{width * k + 1 + 2 * j + at}]" for j in rules) for at in (0, 1))
        return f"({hit} + {PSEUDO * start}D) / ({said} + {PSEUDO}D)"

    good = [rate(0, [j], ON_GOOD) for j in range(_J)]
    rates = list(good)
    for k, theme in enumerate(THEMES, 1):
        own = [j for j, r in enumerate(RULES) if r in theme]
        other = [j for j in range(_J) if j not in own]
        each = {j: rate(k, [j], WITHIN) for j in own}
        full = "(" + " + ".join(each.values()) + ")"
        raised = {j: f"{x} + (1 - {x}) * greatest(0D, ({BROKEN}D - {full}) / ({len(own)} - {full}))" for j, x in each.items()}
        rates += [f"greatest({raised[j] if j in own else rate(k, other, BEYOND)}, {good[j]})" for j in range(_J)]
    new = ", ".join([*new_shares, *(f"least(0.9999D, greatest(0.0001D, {x}))" for x in rates)])
    step = f"(s, i) -> transform(array({sums}), c -> array({new}))[0]"
    return row.select(F.expr(f"aggregate(sequence(1, {ITERATIONS}), {first}, {step})").alias("state"))


def judged(featured: DataFrame, into: str = "_q") -> DataFrame:
    """``featured`` (which should be a written table: it is read twice) with good_probability and kept in the struct column ``into``_v."""
    v = f"{into}_v"
    voted = featured.withColumn(v, votes(into))
    state = em_parameters(voted, v).scalar()
    with_state = voted.withColumn(f"{into}_s", state)
    good = F.expr(f"{_posterior(v, into + '_s')}[0]")
    out = with_state.withColumn(f"{into}_g", good).drop(f"{into}_s")
    failed = F.expr(BASE_FAILED.format(f=into))
    return out.withColumn(v, F.struct(F.col(v).alias("votes"), F.col(f"{into}_g").alias("good_probability"), failed.alias("base_failed"), (~failed & (F.col(f"{into}_g") >= KEEP_AT)).alias("kept"))).drop(f"{into}_g")


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the method keeps, with the columns of ``docs``."""
    names = docs.columns
    renamed = docs.toDF(*(f"c{i}" for i in range(len(names))))
    featured = materialize(with_features(renamed, f"c{names.index(text)}"), "rules")
    return judged(featured).filter("_q_v.kept").select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    featured = materialize(with_features(docs).drop("text"), "rules")
    return judged(featured).select("doc_id", "_q.n_words", "_q.word_chars", "_q.n_symbols", "_q.n_dup_lines", "_q.n_repeat_words", "_q_v.base_failed", "_q_v.kept", (F.col("_q_v.good_probability") >= KEEP_AT).alias("voted_good"))


#: The votes again, by ratios of unnested counts; the EM by joins and groups over (pattern, rule, vote).
_SQL_VOTES = """
  ('length', case when n_words < 20 then -1 when n_words >= 40 then 1 else 0 end),
  ('symbols', case when n_symbols > 0.1 * n_words then -1 when n_symbols <= 0.02 * n_words then 1 else 0 end),
  ('symbol_words', case when n_sw > 0.2 * n_words then -1 when n_sw <= 0.02 * n_words then 1 else 0 end),
  ('bare_words', case when n_bare > 0.1 * n_words then -1 when n_bare <= 0.02 * n_words then 1 else 0 end),
  ('letters', case when n_letters < 0.75 * word_chars then -1 when n_letters >= 0.88 * word_chars then 1 else 0 end),
  ('dup_lines', case when n_dup_lines > 2 and n_dup_lines > 0.3 * n_lines then -1 when n_lines > 1 and n_dup_lines <= 0.05 * n_lines then 1 else 0 end),
  ('repeats', case when n_repeat_words > 0.3 * n_words then -1 when n_repeat_words <= 0.1 * n_words then 1 else 0 end),
  ('pairs', case when n_pairs > 0.45 * n_words then -1 when n_pairs <= 0.3 * n_words then 1 else 0 end),
  ('adjacent', case when n_adjacent > 0.2 * n_words then -1 when n_adjacent <= 0.05 * n_words then 1 else 0 end),
  ('capitals', case when n_capitals > 0.4 * word_chars then -1 when n_capitals <= 0.2 * word_chars then 1 else 0 end),
  ('exclaims', case when n_exclaims > 0.25 * n_words then -1 when n_exclaims <= 0.02 * n_words then 1 else 0 end),
  ('word_size', case when word_chars > 25 * n_words or word_chars < 2 * n_words then -1 when word_chars between 3 * n_words and 12 * n_words then 1 else 0 end)"""


def _sql() -> str:
    start = f"case when c = 0 then {ON_GOOD} when inside then {WITHIN} else {BEYOND} end"
    steps = [
        f"""r{i + 1} as materialized (select pid, c, n, exp(l - max(l) over w) / sum(exp(l - max_l)) over w as p from (select *, max(l) over (partition by pid) as max_l from
  (select pid, c, any_value(n) as n, any_value(ln(share)) + sum(case vote when -1 then ln(rate) when 1 then ln(1 - rate) else 0 end) as l from pv join s{i} using (rule) group by pid, c)) window w as (partition by pid)),
t{i + 1} as materialized (select c, rule, any_value(inside) as inside, any_value(share0) as share0, coalesce(sum(n * p) filter (vote = -1), 0) as hit, coalesce(sum(n * p) filter (vote <> 0), 0) as said, sum(n * p) as w
  from s{i} join (select pid, rule, vote from pv) using (rule) join r{i + 1} using (pid, c) group by c, rule),
g{i + 1} as (select rule, (hit + {PSEUDO * ON_GOOD}) / (said + {PSEUDO}) as b from t{i + 1} where c = 0),
s{i + 1} as materialized (select c, rule, inside, share0, (w + {PSEUDO} * share0) / ((select sum(n) from counted) + {PSEUDO}) as share,
  least(0.9999, greatest(0.0001, case when c = 0 then b when inside then greatest(b, x + (1 - x) * greatest(0, ({BROKEN} - all_x) / (k - all_x))) else greatest(b, tied) end)) as rate
  from (select *, (hit + {PSEUDO * WITHIN}) / (said + {PSEUDO}) as x, sum(x) over g as all_x, count(*) over g as k, (sum(hit) over g + {PSEUDO * BEYOND}) / (sum(said) over g + {PSEUDO}) as tied
    from t{i + 1} window g as (partition by c, inside)) join g{i + 1} using (rule))"""
        for i in range(ITERATIONS)
    ]
    themes = ", ".join(f"({k}, '{r}', {str(r in t).lower()})" for k, t in enumerate(((), *THEMES)) for r in RULES)
    return rf"""
with d as materialized (select row_number() over () as rid, doc_id, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls from documents),
win as (select rid, i, array_to_string(w[i : i + 7], ' ') as s from (select rid, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8)),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, s) as c from win) where c > 1),
rep as (select rid, count(*) as n from (select distinct rid, unnest(range(i, i + 8)) as k from twice) group by rid),
c as materialized (select d.rid, doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) as n_symbols, len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines,
    coalesce(rep.n, 0) as n_repeat_words, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) as n_adjacent, length(t) - length(translate(t, '{_CAPITALS}', '')) as n_capitals,
    length(t) - length(translate(t, '!', '')) as n_exclaims, greatest(len(w) - 1, 0) - len(list_distinct(list_transform(range(2, len(w) + 1), lambda i: w[i - 1] || ' ' || w[i]))) as n_pairs,
    len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>{{}}^~=\\]'))) as n_sw, len(list_filter(w, lambda x: not regexp_matches(x, '[\p{{L}}\p{{M}}\p{{N}}]'))) as n_bare,
    length(t) - length(regexp_replace(t, '[\p{{L}}\p{{M}}\p{{N}}]+', '', 'g')) as n_letters from d left join rep using (rid)),
voted as materialized (select rid, unnest(map_entries(map_from_entries([{_SQL_VOTES}]))) as v from c),
signed as materialized (select rid, string_agg(v.value, ',' order by v.key) as pid from voted group by rid),
counted as (select pid, count(*) as n, min(rid) as rid from signed group by pid),
pv as materialized (select pid, n, v.key as rule, v.value as vote from counted join voted using (rid)),
s0 as materialized (select c, rule, inside, case when c = 0 then 1 - {_K * KIND} else {KIND} end as share0, share0 as share, {start} as rate from (values {themes}) x(c, rule, inside)),
{", ".join(steps)},
last as (select pid, c, any_value(ln(share)) + sum(case vote when -1 then ln(rate) when 1 then ln(1 - rate) else 0 end) as l from pv join s{ITERATIONS} using (rule) group by pid, c),
final as (select pid, sum(exp(l - m)) filter (c = 0) / sum(exp(l - m)) as good from (select *, max(l) over (partition by pid) as m from last) group by pid)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
  n_words < 20 or n_repeat_words > 0.3 * n_words as base_failed, not (n_words < 20 or n_repeat_words > 0.3 * n_words) and good >= 0.5 as kept, good >= 0.5 as voted_good
from c join signed using (rid) join final using (pid)"""


SQL = _sql()
