"""Imports every module that registers queries."""

from corvia.plans import analysis, contracts, corpus, guarded, guidance, matching, ordered, packets, records

MODULES = (analysis, contracts, corpus, guarded, guidance, matching, ordered, packets, records)
