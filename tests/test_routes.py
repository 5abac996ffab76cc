"""Routes and their perimeter by hand."""

from __future__ import annotations

from siftline.operators import routes

FILES = "project string, path string, text string"
SHOP = """<?php
namespace App;
/**
 * @Route("/shop/")
 */
final class Shop extends Base
{
    #[Route('/item/{id}/{slug?}', name: 'item', methods: ['GET'])]
    #[IsGranted('X')]
    public function item(int $id): Response
    {
        return new Basket();
    }

    /**
     * @Route(
     *     name="list",
     *     path="list",
     *     methods="POST"
     * )
     */
    public static function list() { return Money::of(1); }
    private function helper() {
    }
    #[Route]
    protected function bare() {}
    #[Route('/lost')]
}
"""


def test_routes_with_their_prefixes(spark):
    rows = [
        ("p", "src/Web/Shop.php", SHOP), ("p", "src/Web/Api/Ping.php", "<?php\nclass Ping {\n#[Symfony\\Route('//ping//')]\npublic function ping() { }\n}"),
        ("p", "src/Other.php", "<?php\nclass Other {\n#[Route(\"/o\")]\nfunction o() { }\n}"), ("p", "src/None.php", "<?php\nclass None { }"), ("p", "src/Null.php", None), ("p", "src/Basket.php", "<?php class Basket { function m(Money $m) {} }"),
        ("p", "src/Money.php", "<?php class Money {}\nnew Coin();"), ("p", "src/Coin.php", "<?php new Metal();"), ("p", "src/Metal.php", "<?php new Ore();"), ("p", "src/Ore.php", "<?php"),
        ("p", "config/routes.yaml", "web:\n  resource: ../src/Web/\n  prefix: /web\napi:\n  resource: '../src/Web/Api'\n  prefix: \"/api/{version}\"\nnothing:\n  resource: .\n  prefix: /no\nh:\n  controller: App\\Shop::helper\n"),
        ("p", "config/routes/one.yaml", "file:\n  resource: ../src/Other.php\n  prefix: one\n"), ("q", "config/routes.yaml", "w:\n  resource: ../src/\n  prefix: /q\n"),
    ]
    files = spark.createDataFrame(rows, FILES)
    found = routes.routes(files)
    got = {(r.method, r.level, r.declared_by): (r.first, r.last, r.route, r.verbs, r.address) for r in found.collect()}
    assert got == {
        ("item", "class", "annotation"): (10, 21, "/shop/", None, None),
        ("item", "method", "attribute"): (10, 21, "/item/{id}/{slug?}", "GET", "/web/shop/item/x/x"),
        ("list", "method", "annotation"): (22, 22, "list", "POST", "/web/shop/list"),
        ("bare", "method", "attribute"): (26, 29, None, None, None),
        ("helper", "method", "yaml"): (23, 25, None, None, None),
        ("ping", "method", "attribute"): (4, 5, "//ping//", None, "/api/x/ping"),
        ("o", "method", "attribute"): (4, 5, "/o", None, "/one/o"),
    }
    near = {(r.stem, r.hops) for r in routes.perimeter(files, found.where("path like '%Shop.php'")).collect()}
    assert near == {("Shop", 0), ("Basket", 1), ("Money", 1), ("Coin", 2), ("Metal", 3)}


def test_texts_meet_one_order_of_their_rows(spark):
    """Marks far from their method, arguments that the next mark ends, and no sort or shuffle of whole lines."""
    text = "<?php\nclass A {\n#[Route(\n'/a')]\n" + "// Route\n" * 40 + "#[Route('/b')]\n@Route(\nfunction f() {\n}\nfunction g() {\n}"
    files = spark.createDataFrame([("p", "src/A.php", text), ("p", "src/B.php", None), ("p", "src/C.php", "")], FILES)
    df = routes.routes(files)
    assert {(r.method, r.first, r.last, r.route) for r in df.collect()} == {("f", 47, 48, "/a"), ("f", 47, 48, "/b"), ("f", 47, 48, None)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "near" not in plan and "lead(" not in plan
