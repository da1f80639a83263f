"""Personal data by weak supervision, in Spark SQL functions only.

1. Fixed patterns give the base spans of four kinds; looser patterns give further candidates.
2. Five labelers vote on every candidate (yes, no, abstain): pattern, validity, gazetteer, context and boundary.
3. Spark counts the candidates by kind and vote string, at most 4 * 3^5 rows. On those counts expectation-maximisation
   estimates how reliable each labeler is and how likely each vote string means personal data.
4. The posteriors are soft labels for the last model, a naive Bayes span classifier over shape features, whose
   counts Spark aggregates too. Base spans always stay; other candidates count when both models accept them.

Positions come from splitting the text at the same pattern that extracts the matches: a match starts where the
lengths of all gaps and matches before it end.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.llm.shared import documents, fresh_name, stage

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Possessive repeats and the look-behinds give the same matches as the plain patterns
# (email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, ip [0-9]+(\.[0-9]+){3}, card [0-9]([ -]?[0-9])+,
# phone \+[0-9][ ().0-9-]+[0-9]) without trying every place inside a long run again.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Further candidates: spelled-out addresses, bare card numbers inside longer digit groups, phones without a plus.
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}) ?[a-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[a-z0-9-]{1,63}+){1,4}+",
    "card": r"(?<![0-9])[0-9]{13,19}+(?![0-9])",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{2,4}\) ?|0[0-9]{1,4}[ /-])[0-9]{3,4}[ .-]?[0-9]{3,5}(?![0-9-])",
}
_GATE = {"email": "[@(\\[{]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}

# Gazetteers and cue words.
_DOMAINS = r"(?i)(com|org|net|edu|gov|info|io|eu|de|fr|es|uk|us|ch|at|it|nl)$"
_ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65)"
_CUES = {
    "email": r"(?i)(mail|contact|write|reply|from|courriel|correo|kontakt)\W*$",
    "ip": r"(?i)(ip|host|server|client|address|login|from)\W*$",
    "card": r"(?i)(card|visa|credit|debit|karte|carte|tarjeta|payment)\W*(no|number|nr)?\W*$",
    "phone": r"(?i)(phone|tel|call|fax|mobile|cell|contact|telefon|téléphone|teléfono)\W*$",
}
_COUNTER_CUES = r"(?i)(version|isbn|page|order|serial|build|section|§|\$|€|v)\W*$"

VOTES = 5
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,base:boolean,body:string,before:string,after:string>>"


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Checksum test of a short digit string (up to 19 digits)."""
    def weighed(i: Column) -> Column:
        digit = F.ascii(F.substr(digits, F.length(digits) - i, F.lit(1))) - 48
        return F.when(i % 2 == 0, digit).otherwise(digit * 2 - F.when(digit > 4, 9).otherwise(0))

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(places, F.lit(0), lambda total, i: total + weighed(i)) % 10 == 0


def valid(kind: str, body: Column) -> Column:
    digits = F.length(_digits(body))
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return body.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(digits.between(12, 19), luhn(_digits(body))).otherwise(F.lit(False))
    if kind == "phone":
        return digits.between(9, 15)
    return F.lit(True)


def _hits(text: Column, pattern: str, kind: str, base: bool) -> Column:
    """The matches of a pattern with their code point positions and what surrounds them, as far as they are valid for the kind.

    Only kept matches are written to the result, so a long text full of numbers costs one step for each.
    """
    none = F.array().cast(_SPAN)

    def place(parts: Column) -> Column:
        found, gaps = parts["found"], parts["gaps"]

        def add(state: Column, i: Column) -> Column:
            body, before, after = F.element_at(found, i), F.element_at(gaps, i), F.element_at(gaps, i + 1)
            start = state["at"] + F.length(before)
            end = start + F.length(body)
            span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), F.lit(base).alias("base"),
                            body.alias("body"), F.right(before, F.lit(24)).alias("before"), F.left(after, F.lit(8)).alias("after"))
            longer = F.concat(state["spans"], F.array(span).cast(_SPAN))
            return F.struct(end.alias("at"), F.when(valid(kind, body), longer).otherwise(state["spans"]).alias("spans"))

        zero = F.struct(F.lit(0).alias("at"), none.alias("spans"))
        walked = F.aggregate(F.sequence(F.lit(1), F.size(found)), zero, add)["spans"]
        return F.when(F.size(found) > 0, walked).otherwise(none)

    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    placed = F.transform(F.array(parts), place)[0]
    return F.when(text.rlike(_GATE[kind]), placed).otherwise(none)


def candidates(text: Column) -> Column:
    """Base spans of all kinds, then the loose ones that overlap none of them."""
    base = F.concat(*[_hits(text, BASE[kind], kind, True) for kind in KINDS])
    loose = F.concat(*[_hits(text, pattern, k, False) for k, pattern in LOOSE.items()])

    both = F.struct(base.alias("base"), loose.alias("loose"))
    return F.transform(F.array(both), lambda pair: F.when(F.size(pair["loose"]) == 0, pair["base"]).otherwise(F.concat(pair["base"], _free(pair["base"], pair["loose"]))))[0]


def _free(base: Column, loose: Column) -> Column:
    """The loose spans that overlap no base span, in two walks over the spans by start: one meets the base spans that
    begin before a loose one, the other, backwards, those that begin after it."""
    none = F.array().cast(_SPAN)

    def keep(state: Column, s: Column, fits: Column) -> Column:
        return F.when(~s["base"] & fits, F.concat(state["kept"], F.array(s).cast(_SPAN))).otherwise(state["kept"]).alias("kept")

    def forward(state: Column, s: Column) -> Column:
        edge = F.when(s["base"], F.greatest(state["edge"], s["end"])).otherwise(state["edge"])
        return F.struct(edge.alias("edge"), keep(state, s, s["start"] >= state["edge"]))

    def backward(state: Column, s: Column) -> Column:
        edge = F.when(s["base"], s["start"]).otherwise(state["edge"])
        return F.struct(edge.alias("edge"), keep(state, s, s["end"] <= state["edge"]))

    def walk(spans: Column, edge: int, step) -> Column:
        return F.aggregate(spans, F.struct(F.lit(edge).alias("edge"), none.alias("kept")), step, lambda state: state["kept"])

    first = walk(F.array_sort(F.concat(base, loose)), 0, forward)
    return F.transform(F.array(first), lambda kept: walk(F.reverse(F.array_sort(F.concat(base, kept))), 2**31 - 1, backward))[0]


def _vote(yes: Column, no: Column | None = None) -> Column:
    vote = F.when(yes, "1")
    return (vote.when(no, "0") if no is not None else vote).otherwise("-")


def _by_kind(span: Column, choices: dict[str, Column], otherwise: Column) -> Column:
    picked = None
    for kind, value in choices.items():
        picked = F.when(span["kind"] == kind, value) if picked is None else picked.when(span["kind"] == kind, value)
    return picked.otherwise(otherwise)


def votes(span: Column) -> Column:
    """One character per labeler: 1 yes, 0 no, - abstain."""
    body, before, after = span["body"], span["before"], span["after"]
    proper = _by_kind(span, {"card": valid("card", body), "phone": valid("phone", body), "ip": valid("ip", body)}, F.lit(True))
    listed = _by_kind(span, {
        "email": _vote(body.rlike(_DOMAINS)), "card": _vote(_digits(body).rlike(_ISSUERS), ~_digits(body).rlike(_ISSUERS)),
        "ip": _vote(~body.rlike(r"^(0|255)\."), body.rlike(r"^(0|255)\.")), "phone": _vote(body.rlike(r"^(\+[1-9]|0|\()")),
    }, F.lit("-"))
    cue = _by_kind(span, {k: before.rlike(p) for k, p in _CUES.items()}, F.lit(False))
    glued = before.rlike(r"[\p{L}\p{N}_]$") | after.rlike(r"^[\p{L}\p{N}_]")
    return F.concat(_vote(span["base"]), _vote(proper, ~proper), listed, _vote(cue, before.rlike(_COUNTER_CUES)), _vote(~glued, glued))


def features(span: Column) -> Column:
    """Shape features as strings."""
    body, kind = span["body"], span["kind"]
    share = F.floor(F.length(_digits(body)) * 4 / F.length(body))
    def edge(text: Column, first: bool) -> Column:
        one = F.left(text, F.lit(1)) if first else F.right(text, F.lit(1))
        return F.when(text == "", "none").when(one.rlike(r"\s"), "space").when(one.rlike(r"\p{L}"), "letter").when(one.rlike(r"\p{N}"), "digit").otherwise("mark")
    return F.array(
        F.concat(F.lit("length:"), kind, F.lit(":"), F.least(F.length(body), F.lit(40)).cast("string")),
        F.concat(F.lit("digits:"), kind, F.lit(":"), share.cast("string")),
        F.concat(F.lit("before:"), edge(span["before"], False)),
        F.concat(F.lit("after:"), edge(span["after"], True)),
    )


@dataclass(frozen=True)
class SpanModel:
    """Posterior of each (kind, votes), log-odds of each feature value, and the log-odds of the prior."""

    posteriors: dict[str, float] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    prior: float = 0.0


def expectation_maximisation(counts: dict[tuple[str, str], int], rounds: int = 50) -> dict[str, float]:
    """Posterior that a candidate with these votes is personal data; abstentions carry no evidence.

    Starts from the share of yes votes. Each round re-estimates, per labeler, how often it says yes on either class,
    and per kind the share of personal data, with one pseudo-count each.
    """
    def start(pattern: str) -> float:
        cast = [c for c in pattern if c != "-"]
        return (sum(c == "1" for c in cast) + 1) / (len(cast) + 2)

    posterior = {key: start(key[1]) for key in counts}
    for _ in range(rounds):
        yes = {}
        for labeler in range(VOTES):
            for truth in (0, 1):
                weight = {k: n * (posterior[k] if truth else 1 - posterior[k]) for k, n in counts.items() if k[1][labeler] != "-"}
                said = sum(w for k, w in weight.items() if k[1][labeler] == "1")
                # the pseudo-counts hold that labelers are better than chance
                yes[labeler, truth] = (said + (0.8 if truth else 0.2)) / (sum(weight.values()) + 1)
        total = {kind: sum(n for k, n in counts.items() if k[0] == kind) for kind in KINDS}
        share = {kind: (sum(n * posterior[k] for k, n in counts.items() if k[0] == kind) + 0.5) / (total[kind] + 1) for kind in KINDS}
        for key in counts:
            odds = math.log(share[key[0]]) - math.log(1 - share[key[0]])
            for labeler, vote in enumerate(key[1]):
                if vote != "-":
                    a, b = yes[labeler, 1], yes[labeler, 0]
                    odds += math.log(a / b) if vote == "1" else math.log((1 - a) / (1 - b))
            posterior[key] = 1 / (1 + math.exp(-max(-40.0, min(40.0, odds))))
    return {f"{kind}:{pattern}": p for (kind, pattern), p in posterior.items()}


def _lookup(table: dict, key: Column, default: float) -> Column:
    if not table:
        return F.lit(default)
    names = sorted(table)
    pairs = F.map_from_arrays(F.array(*[F.lit(k) for k in names]), F.array(*[F.lit(float(table[k])) for k in names]))
    return F.coalesce(F.element_at(pairs, key), F.lit(default))


def _judged(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, spans): each candidate with its votes and features."""
    found = docs.select("doc_id", candidates(F.col("text")).alias("spans"))
    return found.select("doc_id", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"),
                                                                          s["base"].alias("base"), F.concat(s["kind"], F.lit(":"), votes(s)).alias("votes"), features(s).alias("features"))).alias("spans"))


def fit_spans(judged: DataFrame) -> SpanModel:
    """Both models from the candidates of all documents."""
    each = judged.select(F.explode("spans").alias("s")).select("s.votes", "s.features", "s.kind")
    counted = each.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()
    posteriors = expectation_maximisation({(r["kind"], r["votes"].split(":")[1]): r["n"] for r in counted})
    if not posteriors:
        return SpanModel()
    soft = each.select(F.explode("features").alias("feature"), _lookup(posteriors, F.col("votes"), 0.5).alias("p"))
    sums = soft.groupBy("feature").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    sizes = {r["feature"].split(":")[0]: [0.0, 0.0, 0] for r in sums}
    for r in sums:
        size = sizes[r["feature"].split(":")[0]]
        size[0] += r["yes"]
        size[1] += r["no"]
        size[2] += 1
    weights = {}
    for r in sums:
        yes, no, values = sizes[r["feature"].split(":")[0]]
        weights[r["feature"]] = math.log((r["yes"] + 1) / (yes + values)) - math.log((r["no"] + 1) / (no + values))
    total = sum(r["n"] for r in counted)
    positive = sum(r["n"] * posteriors[r["votes"]] for r in counted)
    return SpanModel(posteriors, weights, math.log((positive + 1) / (total - positive + 1)))


def accepted(spans: Column, model: SpanModel) -> Column:
    """Base spans, and the other candidates that both models take; of overlapping other ones the first stays."""
    def take(s: Column) -> Column:
        odds = F.aggregate(s["features"], F.lit(model.prior), lambda total, f: total + _lookup(model.weights, f, 0.0))
        return s["base"] | ((_lookup(model.posteriors, s["votes"], 0.0) >= 0.5) & (odds > 0))

    shape = "array<struct<start:int,rank:int,end:int,kind:string,base:boolean>>"
    chosen = F.transform(F.array_sort(F.filter(spans, take)), lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "end", "kind", "base")]))

    def add(state: Column, s: Column) -> Column:  # the kept ones end in order, so the last end tells of any overlap
        free = s["start"] >= state["edge"]
        return F.struct(F.when(free, s["end"]).otherwise(state["edge"]).alias("edge"),
                        F.when(free, F.concat(state["kept"], F.array(s))).otherwise(state["kept"]).alias("kept"))

    def resolve(all_spans: Column) -> Column:
        zero = F.struct(F.lit(0).alias("edge"), F.array().cast(shape).alias("kept"))
        others = F.aggregate(F.filter(all_spans, lambda s: ~s["base"]), zero, add, lambda state: state["kept"])
        return F.array_sort(F.concat(F.filter(all_spans, lambda s: s["base"]), others))

    return F.transform(F.array(chosen), resolve)[0]


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans.

    Null text counts as empty and has no spans. Documents are read one by one, so repeated rows, null ids and other
    columns change nothing; an empty table gives no rows. ``spans`` lists base and added spans by start.
    """
    judged = stage(_judged(documents(docs)))
    model = fit_spans(judged)
    chosen = judged.select("doc_id", accepted(F.col("spans"), model).alias("spans"))
    base = F.filter("spans", lambda s: s["base"])

    def of_kind(kind: str):
        return lambda s: s["base"] & (s["kind"] == kind)

    counts = [F.size(F.filter("spans", of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return chosen.select("doc_id", *counts, F.sha2(_digest(base).cast("binary"), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with every accepted span replaced by its kind in brackets; overlapping spans become one."""
    def add(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        between = F.substr(text, state["at"] + 1, s["start"] - state["at"])
        written = F.when(fresh, F.concat(state["out"], between, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), written.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, zero, add, lambda state: F.concat(state["out"], F.substr(text, state["at"] + 1, F.length(text))))


def redact_pii(docs: DataFrame) -> DataFrame:
    """The documents, all columns and rows kept, with personal data redacted in ``text`` and ``n_chars`` renewed if there.

    Columns of any name pass through unchanged. Null text stays null; texts of any length are read whole.
    """
    model = fit_spans(stage(_judged(documents(docs))))
    plain, spans = fresh_name(docs, "plain_text"), fresh_name(docs, "pii_spans")
    marked = docs.withColumn(plain, F.coalesce(F.col("text"), F.lit(""))).withColumn(spans, candidates(F.col(plain)))
    judged = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base"),
                                                   F.concat(s["kind"], F.lit(":"), votes(s)).alias("votes"), features(s).alias("features")))
    written = F.when(F.size(spans) == 0, F.col("text")).otherwise(redact(F.col(plain), accepted(judged, model)))
    redacted = marked.withColumn("text", written)
    if "n_chars" in docs.columns:
        redacted = redacted.withColumn("n_chars", F.when(F.size(spans) == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return redacted.select(docs.columns)
