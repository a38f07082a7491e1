"""Handles seen before are kept by pages: few calls to the state store, none of them lost or given twice."""
from tagloom.streaming import jobs


class Store:
    def __init__(self):
        self.kept, self.calls = {}, 0

    def getMapState(self, *_):
        return self

    def getValue(self, key):
        self.calls += 1
        return self.kept.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.kept[key] = value


def test_calls_follow_pages_not_handles():
    store, seen = Store(), jobs.FirstSeen(None)
    seen.init(store)
    first, more = [f"h{i}" for i in range(5000)], [f"h{i}" for i in range(4000, 6000)]
    assert sorted(seen._unseen(first)) == sorted(first)
    assert sorted(seen._unseen(more)) == sorted(f"h{i}" for i in range(5000, 6000))
    assert seen._unseen(first + more) == [] and store.calls <= 5 * jobs.PAGES
