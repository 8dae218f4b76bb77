"""Schemas of the knowledge tables: explicit, never inferred."""

from __future__ import annotations

_SENSES = "senses map<string,string>, identities map<string,string>, markers map<string,string>"
DDL = {
    "edges": "subject string, relation string, object string, pos string",
    "derived_edges": "subject string, relation string, object string, pos string, source_id string, source_original string, trust double, method string",
    "rules": "rule_id string, kind string, subject string, predicate string, object string, negated boolean, strength string, source_id string, conds array<struct<predicate:string,object:string>>",
    "clauses": f"stmt_id bigint, pos int, op string, attitude double, negated boolean, unknown boolean, quantifier string, wh_role string, contrast boolean, cause string, modal string, {_SENSES}, ironic double, dubitative double, imperative double",
    "dictionary": "word string, pos string, sense string, definition string, vector array<float>, preferred boolean",
    "places": "uid string, name string, type string, parent_admin string, parent_geo string, path_admin array<string>, path_geo array<string>, physical_features array<string>, lon double, lat double",
    "people": "uid string, name string, kind string, channel string, context_key string, aliases array<string>, imprint boolean, canonical_uid string, trust double",
    "axioms": "id string, original string, archived boolean, readonly boolean, trusted double, created_at timestamp",
    "theorems": "id string, original string, archived boolean, trusted double, postable boolean, premises array<string>, chain string, derived_by string, created_at timestamp",
    "log": "id bigint, ts timestamp, source_id bigint, target_id bigint, channel int, directedness double, original string, senses array<string>, metadata string",
    "episodes": "stakeholder_uid string, kind string, delta double, source_id string, ts double",
    "candidates": "id bigint, source string, trigger string, action_token string, urge double, status string, target string",
    "behavior_rules": "trigger string, action string, urge double, enabled boolean, order int",
    "templates": "category string, template string, slots array<string>, weight double, scope string, enabled boolean",
    "ledger": "signature string, premises array<string>, status string, generation int",
    "snapshots": "captured_at timestamp, state string, version string, metrics map<string,double>",
    "posts": "slug string, date timestamp, kind string, title string, body array<string>, published_at timestamp",
}
