"""Plain per-event model of the online semantics, for comparison only.

Nodes and links are held in dicts; an event is added first and scored after.
A cluster over the cap keeps its first nodes by (hop, arrival in reach, id).
"""

from __future__ import annotations

from collections import defaultdict

H = 3600
FRAUD = {"chargeback", "refund_abuse", "confirmed_fraud"}


def half_even(x, k=0):
    return round(x, k) if k else float(round(x))


class Model:
    def __init__(self, cap=200):
        self.cap = cap
        self.first = {}  # node -> (ts)
        self.link = {}  # (c, node) -> dict(first ord, last ts)
        self.users = defaultdict(dict)  # entity -> {c: ord}
        self.own = defaultdict(dict)  # c -> {node: ord}
        self.fraud = {}  # c -> ts
        self.fraud_ord = {}
        self.amount = defaultdict(lambda: [0, 0])
        self.snap = {}  # entity -> (merchants, customers)
        self.n = 0

    def add(self, e):
        o = self.n
        self.n += 1
        c, ts = e["customer_id"], e["ts"]
        self.first.setdefault(("customer", c), ts)
        nodes = [("merchant", e["merchant_id"])] + [(k, e[k]) for k in ("upi", "phone", "device", "email") if e[k]]
        for node in nodes:
            self.first.setdefault(node, ts)
            edge = self.link.setdefault((c, node), {"ord": o, "last": ts})
            edge["last"] = max(edge["last"], ts)
            self.own[c].setdefault(node, o)
            if node[0] != "merchant":
                self.users[node].setdefault(c, o)
        self.amount[c][0] += e["amount"]
        self.amount[c][1] += 1
        for node in nodes[1:]:
            shops = {m for u in self.users[node] for m in self.own[u] if m[0] == "merchant"}
            self.snap[node] = (len(shops), len(self.users[node]))
        if e["outcome"] in FRAUD:
            self.fraud_ord.setdefault(c, o)
            self.fraud[c] = min(self.fraud.get(c, ts), ts)
        return o

    def reach(self, c):
        """[(hop, arrival key, node)] of the whole cluster."""
        own = self.own[c]
        out = {("customer", c): (0, (-1,), f"customer:{c}")}
        for node, o in own.items():
            out[node] = (1, (o,), ":".join(node))
        joins = {}
        for node, o in own.items():
            if node[0] == "merchant":
                continue
            for other, oo in self.users[node].items():
                if other != c:
                    key = (max(o, oo), oo)
                    joins[other] = min(joins.get(other, key), key)
        for other, key in joins.items():
            out[("customer", other)] = (2, key, f"customer:{other}")
        via = {}
        for other, (j, _) in joins.items():
            for node, o in self.own[other].items():
                key = (max(j, o), o)
                via[node] = min(via.get(node, key), key)
        for node, key in via.items():
            if node not in out:
                out[node] = (3, key, ":".join(node))
        return out

    def cluster(self, c):
        everything = self.reach(c)
        ordered = sorted(everything, key=lambda n: everything[n])
        return ordered[: self.cap], len(ordered) > self.cap

    def taint(self):
        levels = {("customer", c): 1.0 for c in self.fraud_ord}
        front = set(levels)
        for value in (0.6, 0.36, 0.216):
            nxt = set()
            for kind, v in front:
                if kind == "customer":
                    nxt |= {n for n in self.own[v] if n[0] != "merchant"}
                else:
                    nxt |= {("customer", u) for u in self.users[(kind, v)]}
            front = {n for n in nxt if n not in levels}
            for n in front:
                levels[n] = value
        return levels

    def score(self, e):
        c, ts = e["customer_id"], e["ts"]
        nodes, truncated = self.cluster(c)
        people = [v for k, v in nodes if k == "customer"]
        count = defaultdict(int)
        for k, _ in nodes:
            count[k] += 1
        taint = self.taint()
        recent = {
            n
            for p in people
            for n in self.own[p]
            if n[0] == "merchant" and self.link[(p, n)]["last"] >= ts - 72 * H
        }
        burn = 0
        for p in people:
            if p not in self.fraud_ord or self.fraud[p] <= 0:
                continue
            f = self.fraud[p]
            left = any(n[0] == "upi" and f <= self.link[(p, n)]["last"] <= f + 48 * H for n in self.own[p])
            new = any(k == "upi" and self.first[(k, v)] > f for k, v in nodes)
            burn |= int(left and new)
        hit = 50_000 <= e["amount"] <= 200_000
        mean = all(50_000 <= self.amount[p][0] / self.amount[p][1] <= 200_000 for p in people)
        fresh = sum(1 for p in people if ts - self.first[("customer", p)] <= 7 * 24 * H)
        ratio = round(len(people) / count["device"], 3) if count["device"] else 0.0
        return {
            "size": len(nodes),
            "truncated": truncated,
            "f1": ratio,
            "f2": max([self.snap[n][0] for n in nodes if n[0] in ("upi", "phone", "device")], default=0),
            "f3": max([taint.get(n, 0.0) for n in nodes]),
            "f4": len(recent),
            "f5": burn,
            "f6": (hit + mean) / 2,
            "f7": round(fresh / len(people), 6),
            "merchants": sorted(v for k, v in nodes if k == "merchant")[:8],
            "devices": sorted(((-self.snap[n][1], n[1], self.snap[n][0]) for n in nodes if n[0] == "device"))[:3],
        }


def replay(events, cap=200):
    model, out = Model(cap), {}
    for e in sorted(events, key=lambda e: (e.get("rank", 1), e["ts"], e["event_id"])):
        model.add(e)
        if e.get("rank", 1) == 1:
            out[e["event_id"]] = model.score(e)
    return out
