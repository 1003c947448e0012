"""Semantic guards: they only ever lower trust in a proposed match."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping as Dict

from mergeloom.plans.contracts import Mapping, MappingEntry, SourceMatch

# Words of column names.
UNIT_WORDS = frozenset({"unit", "birim", "each", "per", "tekil", "piece", "adet"})
AGGREGATE_WORDS = frozenset({
    "total", "toplam", "tutar", "subtotal", "aratoplam", "sum", "ciro", "gross", "brut", "net", "kdv", "vat", "tax", "revenue", "hasilat",
})
MONEY_WORDS = frozenset({
    "price", "fiyat", "tutar", "amount", "cost", "ucret", "bedel", "total", "toplam", "revenue", "ciro", "hasilat", "maliyet",
})
# Words and signs of currencies.
CURRENCIES = {
    "tl": "TL", "try": "TL", "lira": "TL", "tely": "TL", "usd": "USD", "dolar": "USD", "dollar": "USD",
    "eur": "EUR", "euro": "EUR", "avro": "EUR", "gbp": "GBP", "sterlin": "GBP",
}
SIGNS = {"₺": "TL", "$": "USD", "€": "EUR", "£": "GBP"}
SAMPLES = 10


def name_tokens(text: str) -> list[str]:
    """Words of a name in their order; Turkish capitals fold to ASCII, small letters stay."""
    folded = text.translate(str.maketrans("ÇĞİIÖŞÜ", "cgiiosu")).lower()
    return re.findall("[0-9a-zçğıöşü]+", folded)


def currency_of(column: str, samples: Iterable) -> str | None:
    """Of the name's words, then its signs, then of each sample's signs and words."""
    in_words = lambda x: next((CURRENCIES[w] for w in name_tokens(x) if w in CURRENCIES), None)
    in_signs = lambda x: next((c for s, c in SIGNS.items() if s in x), None)
    named = in_words(column) or in_signs(column)
    return named or next((c for x in map(str, samples) if (c := in_signs(x) or in_words(x))), None)


def level_conflict(target: str, source: str) -> str | None:
    """A value for one item that would be filled from an aggregate, or the reverse."""
    t, s = set(name_tokens(target)), set(name_tokens(source))
    if not (t | s) & MONEY_WORDS:
        return None
    for a, b, message in ((t, s, f"'{source}' may be a total, '{target}' is a value for one item."),
                          (s, t, f"'{source}' looks like a value for one item, '{target}' is a total.")):
        if a & UNIT_WORDS and b & AGGREGATE_WORDS and not b & UNIT_WORDS:
            return message
    return None


def _currency_warnings(entry: MappingEntry, samples: Dict[tuple[str, str], list]) -> dict[int, str]:
    found = {}
    for i, m in enumerate(entry.sources):
        if m.status == "auto" and m.column is not None and (c := currency_of(m.column, samples.get((m.file, m.column), []))):
            found[i] = c
    kinds = sorted(set(found.values()))
    if len(kinds) < 2:
        return {}
    return {i: f"'{entry.target}' is fed in several currencies ({', '.join(kinds)}); this source is in {c}." for i, c in found.items()}


def apply_guards(mapping: Mapping, samples: Dict[tuple[str, str], list]) -> Mapping:
    """The plan with doubtful auto matches set to review.

    samples: (file name, column) -> sample values.  A warning about totals wins
    over one about currencies; confidence stays.
    """
    entries = []
    for e in mapping.entries:
        warnings = _currency_warnings(e, samples)
        for i, m in enumerate(e.sources):
            if m.status == "auto" and m.column is not None and (w := level_conflict(e.target, m.column)):
                warnings[i] = w
        sources = [
            m if i not in warnings else SourceMatch(
                m.file, m.column, m.confidence, "review", f"{warnings[i]} Proposed: {m.reason}" if m.reason else warnings[i],
                list(m.samples) if m.samples else list(samples.get((m.file, m.column), []))[:SAMPLES],
            )
            for i, m in enumerate(e.sources)
        ]
        entries.append(MappingEntry(e.target, sources))
    return Mapping(entries)
