from caselight.llm import common


def test_a_new_operator_drops_what_others_keep(monkeypatch):
    monkeypatch.setattr(common, "_CACHE", {})
    for key in (("encoder", 1), ("encoder", 2), ("langid", 1)):
        assert common.cached(key, lambda: key) == key
    assert list(common._CACHE) == [("langid", 1)]
    assert common.cached(("langid", 1), lambda: "not built again") == ("langid", 1)
    for i in range(9):
        common.cached(("langid", 10 + i), lambda: i)
    assert len(common._CACHE) <= 8 and all(k[0] == "langid" for k in common._CACHE)
