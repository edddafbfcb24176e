"""Text -> labelled spans.

Spans stay an array on the document row from detection to masking, so detection never
shuffles; every function here also runs on streaming frames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import checks, scanner
from ..functions.arrays import bind, change, each, lookup, make_span, no_spans
from ..functions.finditer import (char_slice, contains_match, find_all, find_literal, full_match, marked_text, matches_of, unicode_regex)
from ..functions.text import normalize_text
from ..session import written
from . import overlap

# Cheap necessary conditions, one scan each, shared by several patterns.
_GATES = {
    "two_digits": r"\d{2}",
    "five_digits": r"\d{5}",
    "dotted_digits": r"\d\.\d",
    "host": r"://|www\.|[A-Za-z0-9\-]\.[A-Za-z]{2}",
}
_GATE_OF = {
    "resident": "five_digits", "passport": "five_digits", "business": "five_digits", "postcode": "five_digits",
    "card": "two_digits", "account": "two_digits", "phone": "two_digits", "date": "two_digits",
    "time": "two_digits", "ipv4": "dotted_digits", "url": "host", "ip": "dotted_digits", "licence": "two_digits",
}
# The class a match starts with, where that is rarer than the pattern's look-arounds are cheap.
_FIRST = {
    **dict.fromkeys(["resident", "business", "card", "phone", "ipv4", "date", "time", "ip", "licence"], r"\d"),
    "url": r"[A-Za-z0-9\-]", "passport": "[MSmsſ]", "account": r"[가-힣S\d]", "postcode": r"[\(\[\d]",
}


def _gate(name: str, text: Column, staged: dict[str, Column]) -> Column | None:
    if name == "email":
        return F.contains(text, F.lit("@"))
    if name == "address":
        return F.contains(text, F.lit("시")) | F.contains(text, F.lit("도"))
    gate = _GATE_OF.get(name)
    if gate is None:
        return None
    return staged.get(gate, contains_match(text, _GATES[gate]))


def _guard(name: str, text: Column, allow: Iterable[str], deny: Iterable[str]):
    return {
        "resident": lambda m: checks.resident_ok(m["text"]),
        "business": lambda m: checks.business_ok(m["text"]),
        "card": lambda m: checks.luhn_ok(m["text"]),
        "account": lambda m: checks.account_ok(text, m["start"], m["text"]),
        "email": lambda m: checks.email_allowed(m["text"], allow, deny),
        "ipv4": lambda m: ~checks.is_email(m["text"]),
        "url": lambda m: ~checks.is_email(m["text"]),
    }.get(name)


def pattern_spans(text: Column, name: str, pattern: str, label: str, subtype: str, *,
                  allow: Iterable[str] = (), deny: Iterable[str] = (), staged: dict[str, Column] | None = None,
                  guarded: bool = True) -> Column:
    """Spans of one bank pattern, after its validator."""
    found = find_all(text, pattern, _gate(name, text, staged or {}), first=_FIRST.get(name))
    guard = _guard(name, text, allow, deny) if guarded else None
    if guard is not None:
        found = F.filter(found, guard)
    return F.transform(found, lambda m: make_span(
        start=m["start"], end=m["end"], text=m["text"], label=F.lit(label), subtype=F.lit(subtype)))


def _bank(text: Column, entries: Iterable[tuple[str, str, str, str]], staged: dict[str, Column], guards: Callable[[str], Callable | None],
          ignore_case: bool = False, **fixed: Column) -> Column:
    """Spans of several patterns, one after the other.

    The patterns share one scan expression and one span expression, over an array of marked
    texts: a bank is planned as fast as a single pattern.
    """
    rows = list(entries)
    marked = F.array(*[marked_text(text, pattern, _gate(name, text, staged), ignore_case, _FIRST.get(name)) for name, pattern, _, _ in rows])

    def spans(found: Column) -> Column:
        parts = []
        for n, (name, _, label, subtype) in enumerate(rows):
            mine, guard = F.get(found, F.lit(n)), guards(name)
            parts.append(F.struct(F.lit(label).alias("label"), F.lit(subtype).alias("subtype"),
                                  (mine if guard is None else F.filter(mine, guard)).alias("found")))
        return F.flatten(F.transform(F.array(*parts), lambda p: F.transform(p["found"], lambda m: make_span(
            start=m["start"], end=m["end"], text=m["text"], label=p["label"], subtype=p["subtype"], **fixed))))

    return bind(F.transform(marked, lambda m: matches_of(text, m)), spans)


def bank_spans(df: DataFrame, text: str = "text", out: str = "spans", *,
               allow: Iterable[str] = (), deny: Iterable[str] = ()) -> DataFrame:
    """The whole pattern bank with validators, contained spans pruned."""
    return df.withColumn(out, scanner.bank(F.col(text), allow, deny))


def email_allowed_rows(spans: DataFrame, allow: DataFrame, deny: DataFrame, text: str = "text", out: str = "allowed") -> DataFrame:
    """``checks.email_allowed`` with lists of any size as tables ``(suffix)``; adds ``out`` to every row.

    A domain is looked up by its suffixes of the lengths that occur in the lists, by equality; deny
    wins over allow, an empty table is no restriction, an address without a domain is not allowed.
    Verdicts are found once per distinct domain.
    """
    domain = F.lower(F.regexp_extract(F.col(text), r"@([A-Za-z0-9.-]+)\z", 1))
    lists = deny.select("suffix", F.lit(True).alias("bad")).unionByName(allow.select("suffix", F.lit(False).alias("bad"))).where(
        "suffix IS NOT NULL").distinct()
    # one row: the lengths of domain names, which the name system bounds, and whether there is a list of allowed ones
    facts = lists.agg(F.collect_set(F.length("suffix")).alias("sizes"), F.coalesce(F.bool_or(~F.col("bad")), F.lit(False)).alias("strict")).first()
    sizes = F.array(*[F.lit(n) for n in sorted(facts["sizes"])]).cast("array<int>")
    marked = spans.withColumn("_domain", domain)
    names = written(marked.where("_domain <> ''").select("_domain").distinct())
    suffixes = F.transform(F.filter(sizes, lambda n: n <= F.length("_domain")), lambda n: F.when(n == 0, "").otherwise(F.right("_domain", n)))
    hits = names.select("_domain", F.explode(suffixes).alias("suffix")).join(lists, "suffix").groupBy("_domain").agg(
        F.bool_or("bad").alias("_bad"), F.bool_or(~F.col("bad")).alias("_good"))
    verdict = (F.col("_domain") != "") & ~F.coalesce("_bad", F.lit(False))
    if facts["strict"]:
        verdict = verdict & F.coalesce("_good", F.lit(False))
    return marked.join(written(hits), "_domain", "left").withColumn(out, verdict).drop("_domain", "_bad", "_good")


# --- keyword context -------------------------------------------------------------------


def keyword_vote(context: Column) -> Column:
    """Most frequent keyword subtype of a context: ``struct<subtype,score,keyword>`` or null.

    Ties go to the earlier table entry; the reported keyword is the first hit of any subtype.
    """
    votes = []
    for rank, (subtype, words) in enumerate(L.CONTEXT_KEYWORDS):
        hits = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(context, w))
        votes.append(F.struct(F.size(hits).alias("n"), F.lit(-rank).alias("rank"),
                              F.lit(subtype).alias("subtype"), F.get(hits, F.lit(0)).alias("first")))

    def winner(tally: Column) -> Column:
        keyword = F.get(F.filter(F.transform(tally, lambda v: v["first"]), lambda w: w.isNotNull()), F.lit(0))
        return bind(F.array_max(tally), lambda best: F.when(best["n"] > 0, F.struct(
            best["subtype"].alias("subtype"),
            F.least(F.lit(1.0), F.lit(0.6) + F.lit(0.1) * best["n"]).alias("score"),
            keyword.alias("keyword"))))

    return bind(F.array(*votes), winner)


def span_context(text: Column, span: Column, reach: int = L.CONTEXT_REACH) -> Column:
    return char_slice(text, F.greatest(span["start"] - reach, F.lit(0)), span["end"] + reach)


def _refine_number(text: Column, span: Column) -> Column:
    around = char_slice(text, F.greatest(span["start"] - 2, F.lit(0)), span["end"] + 2)
    snippet = char_slice(text, span["start"], span["end"])
    score = F.coalesce(span["score"], F.lit(0.0))

    def fixed(subtype: str, at_least: float) -> Column:
        return change(span, subtype=F.lit(subtype), label_adjusted=F.lit("번호"),
                      score=F.greatest(score, F.lit(at_least)))

    def voted(v: Column) -> Column:
        return F.when(v.isNotNull(), change(
            span, subtype=v["subtype"], score=F.greatest(score, v["score"]), keyword=v["keyword"],
            label_adjusted=F.when(v["subtype"] == "계좌번호", "금융").otherwise("번호"),
        )).otherwise(change(span, label_adjusted=F.lit("번호")))

    by_context = bind(bind(span_context(text, span), keyword_vote), voted)
    return (
        F.when(contains_match(around, L.NEAR_PHONE), fixed("전화번호", 0.95))
        .when(contains_match(snippet, L.NEAR_IP), fixed("IP", 0.90))
        .when(full_match(F.replace(snippet, F.lit(" "), F.lit("")), r"\b\d{5}\b"), fixed("우편번호", 0.85))
        .otherwise(by_context))


def refine_numbers(text: Column, spans: Column) -> Column:
    """Set ``label_adjusted`` everywhere and a finer subtype on spans labelled 번호."""
    def one(s: Column) -> Column:
        done = F.coalesce(s["label_adjusted"], F.lit("")) != ""
        plain = change(s, label_adjusted=F.coalesce(
            s["label_adjusted"], F.coalesce(F.nullif(s["label"], F.lit("")), F.lit("신원"))))
        return F.when(done, s).when(s["label"] == "번호", _refine_number(text, s)).otherwise(plain)

    return F.transform(spans, one)


def domain_spans(text: Column) -> Column:
    """Every occurrence of every domain keyword; overlapping terms are all kept."""
    terms = [(word, label) for label, words in L.DOMAIN_KEYWORDS for word in words]
    table = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(lab).alias("label")) for w, lab in terms])
    present = F.filter(table, lambda t: F.contains(text, t["word"]))
    found = F.flatten(F.transform(present, lambda t: F.transform(find_literal(text, t["word"]), lambda m: make_span(
        start=m["start"], end=m["end"], text=t["word"], label=t["label"], label_adjusted=t["label"],
        score=F.lit(L.DOMAIN_SCORE), source=F.lit("keyword-domain")))))
    # every term is Hangul or one of two Latin words
    latin = [F.contains(text, F.lit(w)) for w, _ in terms if w.isascii()]
    return F.when(text.rlike("[가-힣]") | latin[0] | latin[1], found).otherwise(no_spans())


def detect_default(df: DataFrame, text: str = "text", out: str = "spans", **lists) -> DataFrame:
    """Pattern bank, number refinement and domain keywords: the default detection path."""
    return df.withColumn(out, scanner.default(F.col(text), **lists))


# --- names and the supplementary bank ---------------------------------------------------


def name_spans(text: Column) -> Column:
    """Surname plus one or two syllables with an optional honorific, standing alone."""
    found = find_all(text, L.NAME, text.rlike("[가-힣]{2}|[가-힣][·\\-\\x09-\\x0d\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000][가-힣]"))
    alone = unicode_regex(r"[\p{L}\p{N}]")

    def keep(m: Column) -> Column:
        left = F.when(m["start"] > 0, F.substring(text, m["start"], F.lit(1))).otherwise("")
        right = F.substring(text, m["end"] + 1, F.lit(1))
        return ~left.rlike(alone) & ~right.rlike(alone) & ~m["text"].isin(L.TITLES)

    return F.transform(F.filter(found, keep), lambda m: make_span(
        start=m["start"], end=m["end"], text=m["text"], label=F.lit("이름"), label_adjusted=F.lit("이름"),
        subtype=F.lit(L.NAME_SUBTYPE), score=F.lit(L.NAME_SCORE), source=F.lit("morph")))


def short_name_spans(text: Column) -> Column:
    return F.transform(find_all(text, L.SHORT_NAME, text.rlike("[가-힣]{2}")), lambda m: make_span(
        start=m["start"], end=m["end"], text=m["text"], label=F.lit("이름")))


def proper_noun_spans(text: Column, tokens: Column) -> Column:
    """Runs of consecutive ``NNP`` tokens that look like a name, plus short-name hits, longest first.

    ``tokens``: ``array<struct<text,pos,start,end>>`` in order.
    """
    kind = "array<struct<start:int,end:int>>"
    begin = F.struct(F.lit(False).alias("open"), F.array().cast(kind).alias("runs"))

    def step(acc: Column, t: Column) -> Column:
        runs, last = acc["runs"], F.get(acc["runs"], F.size(acc["runs"]) - 1)
        fresh = F.struct(t["start"].cast("int").alias("start"), t["end"].cast("int").alias("end"))
        grown = F.struct(last["start"].alias("start"), t["end"].cast("int").alias("end"))
        return (
            F.when(~t["pos"].startswith("NNP"), F.struct(F.lit(False).alias("open"), runs.alias("runs")))
            .when(acc["open"], F.struct(F.lit(True).alias("open"), F.array_append(
                F.slice(runs, F.lit(1), F.size(runs) - 1), grown).alias("runs")))
            .otherwise(F.struct(F.lit(True).alias("open"), F.array_append(runs, fresh).alias("runs"))))

    runs = F.aggregate(tokens, begin, step, lambda acc: acc["runs"])
    named = F.filter(F.transform(runs, lambda r: make_span(
        start=r["start"], end=r["end"], text=char_slice(text, r["start"], r["end"]), label=F.lit("이름"))),
        lambda s: ~s["text"].rlike(unicode_regex(r"[^가-힣·\-\s]"))
        & F.length(F.regexp_replace(s["text"], unicode_regex(r"[·\s\-]"), "")).between(2, 4))
    return overlap.greedy_longest(F.concat(named, short_name_spans(text)))


def supplementary_spans(text: Column) -> Column:
    """The second bank: no checksums, score 0.85."""
    return _bank(text, L.SUPPLEMENTARY_BANK, {}, lambda name: None, ignore_case=True,
                 score=F.lit(L.SUPPLEMENTARY_SCORE), source=F.lit("regex"))


def primary_and_supplementary(text: Column, primary: Column, primary_source: str = "ner") -> Column:
    """External entities first; supplementary hits only where none of them covers a character."""
    return overlap.merge_source_first(
        F.concat(primary, overlap.uncovered(supplementary_spans(text), primary)), primary_source)


# --- model output and the full detector -------------------------------------------------


def model_spans(text: Column, predictions: Column) -> Column:
    """Token-classifier predictions as spans; anonymous ``LABEL_n`` groups are dropped.

    ``predictions``: ``array<struct<label,start,end,score>>``.
    """
    kept = F.filter(predictions, lambda p: ~F.upper(p["label"]).startswith("LABEL_"))
    return F.transform(kept, lambda p: make_span(
        start=p["start"], end=p["end"], text=char_slice(text, p["start"], p["end"]), label=p["label"],
        label_adjusted=p["label"], score=F.coalesce(p["score"], F.lit(0.0)), source=F.lit("ner")))


def tag_label(tag: Column) -> Column:
    """Model tag (with or without ``B-``/``I-``) to label, null when unknown."""
    return lookup(L.MODEL_TAGS, F.regexp_replace(tag, r"\A[^-]*-", ""))


def mapped_model_spans(text: Column, predictions: Column) -> Column:
    known = F.filter(F.transform(predictions, lambda p: F.struct(p.alias("p"), tag_label(p["label"]).alias("lab"))),
                     lambda k: k["lab"].isNotNull())
    return F.transform(known, lambda k: make_span(
        start=k["p"]["start"], end=k["p"]["end"], label=k["lab"], score=F.coalesce(k["p"]["score"], F.lit(0.0)),
        text=char_slice(text, k["p"]["start"], k["p"]["end"])))


def as_evidence(text: Column, spans: Column) -> Column:
    """Fill the defaults the merge expects: label, blank subtype to null, score 0, source, text."""
    return F.transform(spans, lambda s: change(
        s, label=F.coalesce(s["label"], F.lit("")), label_adjusted=F.coalesce(s["label_adjusted"], s["label"], F.lit("")),
        subtype=F.nullif(F.trim(s["subtype"]), F.lit("")), score=F.coalesce(s["score"], F.lit(0.0)),
        source=F.coalesce(s["source"], F.lit("regex")),
        text=F.coalesce(F.nullif(s["text"], F.lit("")), char_slice(text, s["start"], s["end"]))))


def detect_all(df: DataFrame, text: str = "text", out: str = "spans", predictions: str | None = None,
               verdicts: str | None = None, use_nfkc: bool = True) -> DataFrame:
    """Normalise, run every detector and merge by priority.

    ``predictions`` names an optional column of model output, ``verdicts`` one of reviewed spans
    (both relative to the normalised text).  The normalised text replaces ``text``.
    """
    if not predictions and not verdicts:
        found = df.withColumn("_found", scanner.everything(F.col(text), use_nfkc))
        return found.withColumns({text: F.col("_found.text"), out: F.col("_found.spans")}).drop("_found")
    base = df.withColumn(text, normalize_text(F.col(text), use_nfkc))
    base = detect_default(base, text, "_found")
    body = F.col(text)
    parts = [as_evidence(body, F.col("_found"))]
    if predictions:
        parts.append(F.coalesce(model_spans(body, F.col(predictions)), no_spans()))
    parts.append(name_spans(body))
    if verdicts:
        parts.append(F.coalesce(F.col(verdicts), no_spans()))
    return base.withColumn(out, overlap.merge_by_priority(F.concat(*parts))).drop("_found")


def explode_spans(df: DataFrame, spans: str, *keep: str) -> DataFrame:
    """One row per span with its position ``ord`` in the array."""
    return each(df, spans, *keep, name="span", position="ord").select(*keep, "ord", "span.*")
