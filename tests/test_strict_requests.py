"""Requests that lack something or say it in another way are rejected, each with its code."""

import copy
import json

from histora.sources import readers

OK_STATE = {"canonicalOid": "c", "publicOid": "p", "hiddenSetId": None}
GOOD = {
    "push": {"incarnation": "i", "batchId": "b", "machineId": "m", "remote": "o", "updates": [
        {"bookmark": "z", "expectedOldOid": None, "states": [OK_STATE], "proposedState": 0, "identityOid": None},
        {"bookmark": "a", "expectedOldOid": "x", "states": [], "proposedState": None, "identityOid": "y"}]},
    "fetch": {"incarnation": "i", "fetchId": "f", "machineId": "m", "remote": "o", "refs": [
        {"bookmark": "z", "observedPublicOid": "p", "expectedCursorOid": None, "states": [OK_STATE], "proposedState": 0, "identityOid": None}]},
    "claim": {"incarnation": "i", "machineId": "m"},
    "recover": {"incarnation": "i", "machineId": "m", "fence": 3, "observations": [{"bookmark": "b", "liveOid": None}, {"bookmark": "a", "liveOid": "x"}]},
    "heads": {"incarnation": "i", "idempotencyKey": "k", "newHead": "a" * 128, "observedHeads": ["z", "b"]},
}


def changed(kind, path, value=...):
    out = copy.deepcopy(GOOD[kind])
    at = out
    for k in path[:-1]:
        at = at[k]
    if value is ...:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return json.dumps(out)


def bad_ones(kind):
    """Requests and the codes they get."""
    yield "{", "not_json"
    yield "[1]", "not_json"
    yield changed(kind, ["more"], 1), "unknown_field"
    for name, value in GOOD[kind].items():
        if name not in ("updates", "refs", "observations", "observedHeads"):
            yield changed(kind, [name]), f"{name}_missing"
            yield changed(kind, [name], None), f"{name}_missing"
            yield changed(kind, [name], "3" if isinstance(value, int) else 3), f"{name}_type"
    if kind == "heads":
        yield changed(kind, ["observedHeads"]), "observedHeads_missing"
        yield changed(kind, ["newHead"], "0" * 128), "new_head_invalid"
        yield changed(kind, ["newHead"], "a"), "new_head_invalid"
        yield changed(kind, ["observedHeads"], ["a", "a"]), "repeated_head"
    if kind in readers.LISTS:
        items = readers.LISTS[kind]
        yield changed(kind, [items]), "list_missing"
        yield changed(kind, [items], "x"), "list_missing"
        yield changed(kind, [items, 0, "more"], 1), "item_unknown_field"
        yield changed(kind, [items], [GOOD[kind][items][0]] * 2), "repeated_name"
        for name in GOOD[kind][items][0]:
            yield changed(kind, [items, 0, name]), f"item_{name}_missing"
        yield changed(kind, [items, 0, "bookmark"], None), "item_bookmark_missing"
        yield changed(kind, [items, 0, "bookmark"], 7), "item_bookmark_type"
    if kind in ("push", "fetch"):
        own = [readers.LISTS[kind], 0]
        yield changed(kind, [*own, "proposedState"], "0"), "item_proposedState_type"
        yield changed(kind, [*own, "proposedState"], 1), "state_outside"
        yield changed(kind, [*own, "proposedState"], -1), "state_outside"
        yield changed(kind, [*own, "states"], 5), "item_states_type"
        yield changed(kind, [*own, "states", 0, "hiddenSetId"]), "state_hiddenSetId_missing"
        yield changed(kind, [*own, "states", 0, "publicOid"], None), "state_publicOid_missing"
        yield changed(kind, [*own, "states", 0, "more"], 1), "state_unknown_field"
        yield changed(kind, [*own, "states", 0, "publicOid"], "c"), "identity_mapping"
        yield changed(kind, [*own, "identityOid"], "p"), "identity_with_states"
    if kind == "push":
        yield changed(kind, ["updates", 0, "proposedState"], None), "states_without_proposal"
        yield changed(kind, ["updates", 0, "states"], [OK_STATE, OK_STATE]), "repeated_mapping"
    if kind == "fetch":
        yield changed(kind, ["refs", 0, "observedPublicOid"], "q"), "proposal_not_observed"
        yield changed(kind, ["refs", 0, "observedPublicOid"], None), "item_observedPublicOid_missing"
        yield json.dumps(GOOD[kind] | {"refs": [GOOD[kind]["refs"][0] | {"states": [], "proposedState": None, "identityOid": "y"}]}), "proposal_not_observed"


def test_every_kind_and_code(spark, tmp_path):
    for kind, good in GOOD.items():
        cases = list(bad_ones(kind))
        path = tmp_path / kind
        path.write_text("\n".join([json.dumps(good), *(line for line, _ in cases), ""]))
        found, rejected = readers.read_requests(spark, str(path), kind)
        assert [r.raw for r in found.collect()] == [json.dumps(good)]
        assert {r.raw: r.code for r in rejected.collect()} == dict(cases)
    names = [u.bookmark for u in readers.read_requests(spark, str(tmp_path / "push"), "push")[0].first().updates]
    assert names == ["a", "z"]
