"""Ordered rule lists turned into one ``CASE WHEN`` Column (first matching rule wins).

A rule is ``(condition Column, label)``; a NULL condition does not match. The chain is a
single JVM expression, evaluated per row inside whole-stage code generation.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsmetrics.functions.semantics import ilike_any, parse_int

# fixed values: ticket-text patterns and labels of the replacement-reason rules
DAMAGE_PATTERNS = ("%damage%", "%tear%")
SLEEVE_PATTERN = "%Jacket Sleeve Tailoring%"
MISSING_PATTERNS = ("%missing%", "%arrived%", "%lost%", "%not delivered%", "%not received%", "%didn't received%")
WRONG_PATTERN = "%wrong%"
DELIVERY_PATTERNS = ("%returned to the sender%", "%returned to sender%", "WAS RETURNED", "%delivered%")
WRINKLE_PATTERN, STOLEN_PATTERN, EXTEND_PATTERN = "%wrinkle%", "%stolen%", "%extend%"
JACKET, SHIRT, PANT = "%jacket%", "%shirt%", "%pant%"
DAMAGED, TAILORED, MISSING, WRONG_ITEM = "Damaged", "tailored to size", "Missing Item", "Wrong Item"
DELIVERY_ISSUE, WRINKLED, STOLEN, EXTENDERS = "delivery issue", "Wrinkled Item", "stolen", "Extenders sent for shirt"
WRONG_REPLACEMENT, BUNDLE = "Wrong Replacement Sent", "pant-jacket bundle replacement"


def first_match(rules: Sequence[tuple[Column, str]] | None = None, default=None) -> Column:
    """Fold rules into ``when(c1, l1).when(c2, l2)...otherwise(default)``."""
    rules = list(rules if rules is not None else replacement_reason_rules())
    out = F.when(rules[0][0], F.lit(rules[0][1]))
    for cond, label in rules[1:]:
        out = out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default)) if default is not None else out


def item_predicates(style: str = "product_style_name", length: str = "sku_length",
                    requested: str | None = "requested_length",
                    tailoring: str = "replace_tailoring") -> dict[str, Column]:
    """The item-side conditions the reason rules read (the rest is ticket text)."""
    s, tail = F.col(style), F.col(tailoring)
    if requested is None:
        gap1 = gap2 = F.lit(None).cast("boolean")
    else:
        gap = parse_int(length) - parse_int(requested)
        gap1, gap2 = (gap == 1) & tail.like("%1%"), (gap == 2) & tail.like("%2%")
    return {
        "gap1_tailored": gap1,
        "gap2_tailored": gap2,
        "has_tailoring": tail.isNotNull(),
        "jacket": s.ilike(JACKET),
        "shirt": s.ilike(SHIRT),
        "pant": s.ilike(PANT),
        "size_mismatch": ((F.col("nxt_replace_size") != F.col("replacement_sku_size"))
                          | (F.col("nxt_replace_length") != F.col("replacement_sku_length"))),
    }


def reason_rules(comments: Column, item: dict[str, Column]) -> list[tuple[Column, str]]:
    """Reason rules in priority order over ticket text ``comments`` and item predicates."""
    c = comments
    return [
        (ilike_any(c, DAMAGE_PATTERNS), DAMAGED),
        (item["gap1_tailored"], TAILORED),
        (item["gap2_tailored"], TAILORED),
        (item["has_tailoring"], TAILORED),
        (c.like(SLEEVE_PATTERN), TAILORED),
        (ilike_any(c, MISSING_PATTERNS), MISSING),
        (c.ilike(WRONG_PATTERN), WRONG_ITEM),
        (ilike_any(c, DELIVERY_PATTERNS), DELIVERY_ISSUE),
        (item["jacket"] & c.ilike(WRINKLE_PATTERN), WRINKLED),
        (c.ilike(STOLEN_PATTERN), STOLEN),
        (item["shirt"] & c.ilike(EXTEND_PATTERN), EXTENDERS),
        (item["size_mismatch"], WRONG_REPLACEMENT),
        (item["pant"] & c.ilike(JACKET) & ~c.ilike(PANT), BUNDLE),
        (item["jacket"] & c.ilike(PANT) & ~c.ilike(JACKET), BUNDLE),
    ]


def replacement_reason_rules(comments: str = "ticket_comments", style: str = "product_style_name",
                             length: str = "sku_length", requested: str = "requested_length",
                             tailoring: str = "replace_tailoring") -> list[tuple[Column, str]]:
    """Reason rules on one row holding the ticket text and the item columns."""
    return reason_rules(F.col(comments), item_predicates(style, length, requested, tailoring))


@dataclass(frozen=True)
class TextRule:
    """A label and what a text and its item must have for it. LIKE patterns; ``any_of`` and ``none_of`` in any case,
    ``same_case`` as written. ``item`` names conditions of the item that must all hold."""
    label: str
    any_of: tuple[str, ...] = ()
    same_case: tuple[str, ...] = ()
    none_of: tuple[str, ...] = ()
    item: tuple[str, ...] = ()


#: The replacement-reason rules in order. Two further ones compare the requested length of a form with the item; both need a
#: tailoring note, so the rule for that note gives the same label and they are left out.
REASON_RULES = (
    TextRule(DAMAGED, any_of=DAMAGE_PATTERNS),
    TextRule(TAILORED, item=("has_tailoring",)),
    TextRule(TAILORED, same_case=(SLEEVE_PATTERN,)),
    TextRule(MISSING, any_of=MISSING_PATTERNS),
    TextRule(WRONG_ITEM, any_of=(WRONG_PATTERN,)),
    TextRule(DELIVERY_ISSUE, any_of=DELIVERY_PATTERNS),
    TextRule(WRINKLED, any_of=(WRINKLE_PATTERN,), item=("jacket",)),
    TextRule(STOLEN, any_of=(STOLEN_PATTERN,)),
    TextRule(EXTENDERS, any_of=(EXTEND_PATTERN,), item=("shirt",)),
    TextRule(WRONG_REPLACEMENT, item=("size_mismatch",)),
    TextRule(BUNDLE, any_of=(JACKET,), none_of=(PANT,), item=("pant",)),
    TextRule(BUNDLE, any_of=(PANT,), none_of=(JACKET,), item=("jacket",)),
)


class TextLabeller:
    """An ordered rule list compiled to one pattern per case mode.

    ``hits`` scans a text once and yields the set of patterns that it matches; ``label`` looks the rules up in that set.
    All patterns of the form ``%literal%`` are alternatives, longest first, of a look-ahead, so matches may overlap; a
    literal inside a matched longer one counts as matched too. Patterns of another form are tested one by one.
    """

    def __init__(self, rules: Sequence[TextRule]):
        self.rules = list(rules)
        self.any_case = sorted({p.lower() for r in rules for p in (*r.any_of, *r.none_of)})
        self.as_written = sorted({p for r in rules for p in r.same_case})

    @staticmethod
    def literal(pattern: str) -> str | None:
        inner = pattern[1:-1]
        plain = len(pattern) > 2 and pattern[0] == pattern[-1] == "%" and not re.search(r"[%_\\]", inner)
        return inner if plain else None

    def _set(self, text: Column, patterns: Sequence[str], tag: str) -> Column:
        literals = sorted((x for p in patterns if (x := self.literal(p))), key=lambda x: (-len(x), x))
        parts = []
        if literals:
            regex = "(?=(" + "|".join("\\Q" + x.replace("\\E", "\\E\\\\E\\Q") + "\\E" for x in literals) + "))"
            found = F.array_distinct(F.regexp_extract_all(text, F.lit(regex), F.lit(1)))
            parts.append(F.transform(found, lambda x: F.concat(F.lit(tag + "%"), x, F.lit("%"))))
        for p in patterns:
            if not self.literal(p):
                parts.append(F.when(text.like(p), F.array(F.lit(tag + p))).when(text.isNotNull(), F.array().cast("array<string>")))
        return F.concat(*parts) if parts else F.when(text.isNotNull(), F.array().cast("array<string>"))

    def hits(self, text: Column) -> Column:
        """The patterns that a text matches, those for any case tagged ``i``, others ``s``; NULL for a NULL text."""
        return F.concat(self._set(F.lower(text), self.any_case, "i"), self._set(text, self.as_written, "s"))

    def _matched(self, hits: Column, pattern: str, tag: str, patterns: Sequence[str]) -> Column:
        x = self.literal(pattern)
        longer = [p for p in patterns if x and (y := self.literal(p)) and x in y] or [pattern]
        return F.arrays_overlap(hits, F.array(*[F.lit(tag + p) for p in longer]))

    def label(self, hits: Column, item: dict[str, Column]) -> Column:
        """The label of the first rule that holds, NULL if none does."""
        conditions = []
        for r in self.rules:
            some = ([self._matched(hits, p.lower(), "i", self.any_case) for p in r.any_of]
                    + [self._matched(hits, p, "s", self.as_written) for p in r.same_case])
            parts = [_any(some)] if some else []
            parts += [~self._matched(hits, p.lower(), "i", self.any_case) for p in r.none_of]
            parts += [item[n] for n in r.item]
            conditions.append((_all(parts), r.label))
        return first_match(conditions)


def _any(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0] if conditions else F.lit(True)
    for c in conditions[1:]:
        out = out & c
    return out


def vendor_label(code: Column, category: Column, rules: Sequence[tuple[str, Sequence[str], str]],
                 default: str = "") -> Column:
    """Vendor code -> label; a rule may exclude categories by pattern. No match -> ``default``."""
    conds = []
    for value, excluded, label in rules:
        cond = code == F.lit(value)
        for pat in excluded:
            cond = cond & ~category.ilike(pat)
        conds.append((cond, label))
    if not conds:
        return F.lit(default)
    return first_match(conds, default)
