"""Declared structure and function metrics, against hand-counted cases."""

from pyspark.sql import functions as F

from arcwell.sources import lines, metrics_scan, structure


def files(spark, **texts):
    return spark.createDataFrame([(k.replace("__", "."), v) for k, v in texts.items()], "file string, text string")


# Counted by hand below each: decisions + 1; each structure 1 + its depth, runs of one operator 1.
LEDGER = """class Ledger {
    /* while (this is a comment) { */
    long settle(java.util.List<Entry> book, boolean strict) {
        long due = 0;
        for (Entry e : book) {
            while (e.open() && strict) {
                if (e.amount() > 7) { due += e.amount(); }
            }
        }
        if (due == 0) { return -1; }
        return due;
    }
    String label() { return "for (;;) { if }"; }
}
"""
BOARD = """export function place(board: string[][], mark: string): number {
  let free = 0;
  for (const row of board) {
    for (const cell of row) {
      if (cell === '' || cell === mark) {
        free += 1;
      }
    }
  }
  return free > 9 ? 9 : free;
}
export const zero = (): number => 0;
"""


def test_function_metrics(spark):
    got = {r["name"]: tuple(r)[2:] for r in metrics_scan.function_metrics(files(spark, Ledger__java=LEDGER, board__ts=BOARD, c__py="if x: pass")).collect()}
    # settle: for, while, &&, if, if: 1 + 5. for 1, while 2, && 1, if 3, if 1. place: for, for, if, ||, ?: 1 + 5.
    assert got["settle"] == (3, 6, 8, 3) and got["label"] == (13, 1, 0, 0)
    assert got["place"][:2] == (1, 6) and got["place"][3] == 3 and got["zero"][1:] == (1, 0, 0) and len(got) == 4
    (f,) = metrics_scan.file_function_metrics(metrics_scan.function_metrics(files(spark, Ledger__java=LEDGER))).collect()
    assert (f["cyclomatic"], f["functions"], f["worst"]) == (7, 2, "settle")


def test_switch_labels():
    text = "void f(int x) { switch (x) { case 1: if (a) { b(); } break; default: c(); } }"
    assert list(metrics_scan.Scan(text, True).functions()) == [("f", 1, 4, 3, 1)]
    assert list(metrics_scan.Scan(text.replace("void ", "").replace("int ", "")).functions()) == [("f", 1, 3, 3, 2)]


def test_db_tables(spark):
    d = files(
        spark,
        s__sql="CREATE TABLE IF NOT EXISTS app.orders (\n id INT PRIMARY KEY,\n total NUMERIC(10, 2) NOT NULL,\n who INT,\n CONSTRAINT f FOREIGN KEY (who) REFERENCES people (id)\n);",
        p__prisma="model User {\n  id Int @id\n  mail String? @unique\n  posts Post[]\n}\n", m__py="class Car(models.Model):\n    name = models.CharField(max_length=9, null=True)\n    maker = models.ForeignKey('Maker', on_delete=1)\nclass Z:\n    x = 1\n",
        E__java="@Entity\n@Table(name = \"INVOICE\")\nclass E {\n  @Id\n  private Long id;\n  @Column(name = \"ST\")\n  private String status;\n}", t__ts="@Entity('user')\nexport class U {\n  @PrimaryGeneratedColumn()\n  id: number;\n  @Column({ nullable: true })\n  name: string;\n}",
        q__js="sequelize.define('pet', { name: { type: DataTypes.STRING, allowNull: true }, id: { type: DataTypes.INTEGER, primaryKey: true } })",
    )
    got = {(r["source"], r["table_name"], r["column_name"], r["nullable"], r["primary_key"], r["ref_table"]) for r in structure.db_tables(d).collect()}
    assert got == {
        ("sql", "orders", "id", False, True, None), ("sql", "orders", "total", False, False, None), ("sql", "orders", "who", True, False, "people"),
        ("prisma", "User", "id", False, True, None), ("prisma", "User", "mail", True, False, None), ("django", "Car", "name", True, False, None), ("django", "Car", "maker", False, False, "Maker"),
        ("jpa", "INVOICE", "id", False, True, None), ("jpa", "INVOICE", "ST", True, False, None), ("typeorm", "user", "id", False, True, None), ("typeorm", "user", "name", True, False, None),
        ("sequelize", "pet", "name", True, False, None), ("sequelize", "pet", "id", False, True, None),
    }


def test_front_end(spark):
    text = "@NgModule({ declarations: [AComp, BComp], imports: [RouterModule.forRoot([x]), Y] })\nexport class AppModule {}\nconst r = [{ path: 'a', loadChildren: () => import('./a.module') }];\nexport const load = createAction('x');\n"
    d = files(spark, a__ts=text)
    (m,) = structure.ng_modules(d).collect()
    assert (m["name"], m["declarations"], [tuple(x) for x in m["lazy_routes"]]) == ("AppModule", ["AComp", "BComp"], [("a", "./a.module")])
    assert [(r["type"], r["name"]) for r in structure.store_items(lines.file_lines(d)).collect()] == [("action", "load")]
    d = spark.createDataFrame([("s/kitA.osw", '{"a": "Other"}'), ("x/KitAController.tsx", ""), ("x/Other.ts", ""), ("y/Other.ts", "")], "file string, text string")
    assert {tuple(r) for r in structure.screen_links(d).collect()} == {("s/kitA.osw", "x/KitAController.tsx", "resolved"), ("s/kitA.osw", "x/Other.ts", "inferred"), ("s/kitA.osw", "y/Other.ts", "inferred")}


def test_java_types(spark):
    d = files(spark, Pay__java="package a.pay;\npublic interface Pay {\n}", S__java="package a.x;\nimport a.pay.Pay;\npublic class S extends Base<T> implements Pay, Q {\n}", P2__java="package a.pay;\nclass P2 implements Pay {}", W__java="package w;\nimport a.pay.*;\nclass W {}", Other__java="package o;\ninterface Pay {}")
    t = structure.java_types(d)
    assert ("a.pay.Pay", "a.x.S") in {tuple(r) for r in structure.implementors(t).collect()}
    uses = d.select("file", F.lit("Pay").alias("simple"))
    got = {(r["file"], r["full_name"]): r["tier"] for r in structure.resolve_types(uses, t, d).collect()}
    assert got == {("S.java", "a.pay.Pay"): 1, ("P2.java", "a.pay.Pay"): 2, ("Pay.java", "a.pay.Pay"): 2, ("W.java", "a.pay.Pay"): 3, ("Other.java", "o.Pay"): 2}
