"""All registered queries and their SQL."""

from __future__ import annotations

from emberlake.plans import guarding, recall, stored, traffic

QUERIES = {**recall.QUERIES, **guarding.QUERIES, **traffic.QUERIES, **stored.QUERIES}
SQL = {**recall.SQL, **guarding.SQL, **traffic.SQL, **stored.SQL}
