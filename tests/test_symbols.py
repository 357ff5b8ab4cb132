"""What calls mean, over several files, and what routes reach."""

import pytest
from sediment.operators import imports, routes, symbols
from sediment.plans.engine import Engine
from sediment.sources.repo import from_rows

FILES = {
    "app/__init__.py": "",
    "app/api.py": """from fastapi import FastAPI
from app.services import OrderService as Orders, helpers
from .util import clean
import app.store.db
import app.store.db as database

app_ = FastAPI()


@app_.get('/orders')
async def orders(service: Orders, n: int = 1):
    clean(n)
    rows = service.all()
    helpers.shape(rows)
    app.store.db.connect()
    database.connect()
    return unknown(len(rows))


@app_.post('/orders')
def add():
    made = Orders()
    made.save(1)
    def later():
        made.drop()
    return later or Orders().all() or clean(1).upper() or made.model.find(2)


print(clean(1))
""",
    "app/services/__init__.py": "from .order import OrderService\nfrom . import helpers\n",
    "app/services/helpers.py": "def shape(x):\n    return x\n",
    "app/services/order.py": """from app.base import Service
from app.models import Order


class OrderService(Service):
    def __init__(self):
        super().__init__()
        self.model = Order()

    def all(self):
        return self.model.find(self.limit())

    def save(self, x):
        return super().save(x)
""",
    "app/base.py": "class Root:\n    def limit(self):\n        return 1\n\n\nclass Service(Root):\n    def __init__(self):\n        pass\n\n    def save(self, x):\n        return self.limit()\n",
    "app/models.py": "class Order:\n    def find(self, n):\n        return n\n",
    "app/util.py": "def clean(x):\n    return clean_more(x)\n\n\ndef clean_more(x):\n    return x\n",
    "app/store/__init__.py": "",
    "app/store/db.py": "def connect():\n    pass\n",
    "app/broken.py": "def (:\n",
}


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine.of(spark, FILES)
    yield e
    e.close()


@pytest.fixture(scope="module")
def calls(engine):
    return symbols.resolved_calls(engine.files).persist()


def of(calls, src):
    return [(r["call"], r["dst"]) for r in calls.filter(calls["src"] == src).orderBy("ord").collect()]


def test_calls_mean_definitions_elsewhere(calls):
    api, order = "app/api.py#", "app/services/order.py#OrderService"
    assert of(calls, api + "orders") == [
        ("clean", "app/util.py#clean"),
        ("Orders.all", order + ".all"),
        ("helpers.shape", "app/services/helpers.py#shape"),
        ("app.store.db.connect", "app/store/db.py#connect"),
        ("database.connect", "app/store/db.py#connect"),
        ("unknown", None),
        ("len", None),
    ]
    # a class is what its call means; nested functions are part of the one around them; a base's method through its alias
    assert of(calls, api + "add") == [("Orders", order), ("Orders.save", order + ".save"), ("Orders.drop", order), ("Orders.all", order + ".all"), ("Orders", order), ("clean.upper", None), ("clean", "app/util.py#clean"), ("Orders.model.find", order)]
    assert of(calls, api) == [("FastAPI", None), ("print", None), ("clean", "app/util.py#clean")]


def test_members_and_bases(calls):
    order, base = "app/services/order.py#OrderService", "app/base.py#"
    assert of(calls, order + ".__init__") == [("super.__init__", base + "Service.__init__"), ("super", None), ("Order", "app/models.py#Order")]
    assert of(calls, order + ".all") == [("Order.find", "app/models.py#Order.find"), ("OrderService.limit", base + "Root.limit")]
    assert of(calls, order + ".save")[0] == ("super.save", base + "Service.save")
    assert of(calls, "app/util.py#clean") == [("clean_more", "app/util.py#clean_more")]


def test_routes_reach_through_all_calls(engine, calls):
    found = symbols.route_reach(routes.routes(engine.files), calls, imports.import_edges(engine.files))
    got = {(r["method"], r["vertex"].split("#")[1]): (r["depth"], r["risk"]) for r in found.collect()}
    assert got[("GET", "clean_more")] == (2, "PERIPHERAL") and got[("GET", "Order.find")][0] == 2 and got[("GET", "Root.limit")][0] == 2
    assert got[("POST", "Root.limit")][0] == 2 and got[("POST", "Order.find")][0] == 2


def test_calls_keep_their_order(engine):
    assert [r["calls"] for r in routes.routes(engine.files).filter("method = 'POST'").collect()] == [["Orders", "clean"]]
    text = "import b, a\n\n@x.get('/')\ndef f():\n    return b.two(a.one(), b.three())\n"
    files = Engine.of(engine.spark, {"m.py": text}).files
    assert [r["calls"] for r in routes.routes(files).collect()] == [["b", "a"]]


def test_no_files(spark):
    files = Engine.of(spark, {"a.txt": "x", "b.py": "def ("}).files
    assert symbols.resolved_calls(files).count() == 0


def test_calls_and_reach_are_not_broadcast(spark):
    """Symbols compress well: what is small on disk was broadcast, and went through the driver at every step."""
    files = from_rows(spark, {f"a{k}.py": f"class A{k}:\n    def f(self):\n        return self.g()\n\n    def g(self):\n        return 1\n" for k in range(5)})
    calls = symbols.resolved_calls(files)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(calls)
    assert calls.filter("dst is not null").count() == 5
    reached = symbols.route_reach(spark.createDataFrame([("GET", "/", "a1.py", "A1.f")], "method string, route string, path string, handler string"), calls, spark.createDataFrame([("a2.py", "a1.py")], "src string, dst string"))
    assert "Broadcast" not in plan(reached)
    assert [r["vertex"] for r in reached.collect()] == ["a1.py#A1.g"]
