import pytest

from millrace import config as C


def test_layers_overrides_and_references():
    base = {"a": {"x": 1, "y": [1]}, "b": "text", "paths": {"out": "/p"}}
    made = C.merged(base, {"a": {"+y": [2], "x": None}, "c": "${a.z}"}, C.from_environment("CFG", {"CFG_a__z": "5", "CFG_b": "word", "OTHER": "1"}), C.from_arguments(["a.w=[1, 2]", "d=${ENV:NOT_SET/7}", "e=is ${b}"]))
    assert made == {"a": {"y": [1, 2], "z": 5, "w": [1, 2]}, "b": "word", "paths": {"out": "/p"}, "c": "${a.z}", "d": "${ENV:NOT_SET/7}", "e": "is ${b}"}
    assert base["a"] == {"x": 1, "y": [1]}
    got = C.resolved(made, {})
    assert (got["c"], got["d"], got["e"]) == (5, 7, "is word")
    with pytest.raises(ValueError):
        C.resolved({"a": "${b}", "b": "${a}"}, {})
    for wrong in ({"a": "${b}"}, {"a": "${ENV:NOT_SET}"}):
        with pytest.raises(KeyError):
            C.resolved(wrong, {})
    assert C.config_fingerprint(made) == C.config_fingerprint({k: v for k, v in made.items() if k != "paths"}) != C.config_fingerprint(base)
    with pytest.raises(ValueError):
        C.from_arguments(["nothing"])
