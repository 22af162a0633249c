"""Queries pN_ of the text problems and their SQL."""

from __future__ import annotations

from graphloom.llm import bpe, generated, mixing, parsing, pii
from graphloom.tables import table


def p1_found(s, d):
    return parsing.unparsable(table(s, d, "source_files"))


def p1_rates(s, d):
    return parsing.parse_rates(table(s, d, "source_files"), table(s, d, "units"))


def p5_found(s, d):
    return generated.not_by_hand(table(s, d, "source_files"), table(s, d, "upstream_files"))


def p5_kinds(s, d):
    return generated.classified(table(s, d, "source_files"), table(s, d, "upstream_files")).filter("kind is not null")


def p5_rules(s, d):
    return generated.rule_counts(table(s, d, "source_files"), table(s, d, "upstream_files"))


def p5_hand_written(s, d):
    return generated.hand_written(table(s, d, "source_files"), table(s, d, "upstream_files"), table(s, d, "units"))


def p7_ids(s, d):
    return bpe.token_ids(table(s, d, "documents"))


def p8_mix(s, d):
    return mixing.mixed(table(s, d, "documents"), table(s, d, "mix_targets"))


def p8_shares(s, d):
    return mixing.shares(table(s, d, "documents"), table(s, d, "mix_targets"))


def p9_found(s, d):
    return pii.found(table(s, d, "documents"), table(s, d, "known_names"))


def p9_masked(s, d):
    return pii.masked(table(s, d, "documents"), table(s, d, "known_names"))


QUERIES = {f.__name__: f for f in (p1_found, p1_rates, p5_found, p5_kinds, p5_rules, p5_hand_written, p7_ids, p8_mix, p8_shares, p9_found, p9_masked)}
ORACLES: dict[str, str] = {}
