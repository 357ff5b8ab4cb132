"""Shapes of declarations that lines and one level of brackets don't show."""

import pytest
from sediment.operators import entities, structure
from sediment.operators.tokens import masked, nested, scanned, tokens
from sediment.sources.repo import from_rows

FILES = {
    "A.java": """// class No {
package a;
@Entity @Table(name="x")
public sealed class Dog<T extends Map<String, List<T>>> extends Animal<Foo<T>>
    implements Pet<A, B>,
               Toy permits X, Y {
  /* } */ private Map<String,
     List<Integer>> m = new HashMap<>();
  int a, b = 3;
  public Dog(int x) { }
  public <T> List<T> load(int a,
      Map<String, T> b) throws E { return "}"; }
  static class Inner { int z; }
}
record P(int a, Map<String, List<Integer>> m) {}
""",
    "x/S.cs": """namespace Uni.Structures;
[Table("t")] public class S<T>(int a) : Base<Foo<int>>, IThing where T : class {
  [Key] public int Id { get; set; } = 5;
  public List<List<int>> Xs => new();
  private string s = @"a""}";
  public T Load<T>(int a) where T : class => default;
}
public interface ITree<T> : IBase<T>
{
  int Count { get; }
  T Get(int at);
}
public record Node(int Id, string? N = null);
""",
    "p.php": """<p class="x"><?php
namespace App\\Models;
# comment {
#[Attr(1)]
final class A extends \\Foo\\Bar implements I, J {
  public function __construct(private readonly ?int $x, protected (B&C)|null $y = null, $z = 1) { }
  private string $n, $m = 'x';
  public static $q;
  const K = 1;
}
enum Suit: string implements HasL { case H = 'h'; public function label(): string { return <<<X
 } class Z {
X; } }
""",
    "t.ts": """export class T<X> extends Base<X> implements A, B {
  private x: Map<string, number> = new Map()
  @Input() y?: string
  z = 1;
  constructor(private readonly http: Client<Foo, Bar>, other: number) { super() }
  get name(): string { return `a ${ {b: `}`} } }`; }
  handle = async (e: Event) => { return e }
  async load<T>(a: T,
     b = {c: 1}): Promise<T[]> { return [] }
}
interface Props { a: string, b?: number; c(x: number): void
  d: { e: string }
  [k: string]: any }
type Config = { debug: boolean; list: Array<Map<string, X>> }
export default function Card({ a, b }: Props) { return null }
export const Panel: React.FC<Props> = ({ a }) => { return a }
const lower = () => 1
export async function GET(req: Request) { return 1 }
""",
    "g.go": """package g
// type Fake struct { x int }
type (
  A struct {
    B, C int `json:"b"`
    *pkg.Base
    m map[string]*User
  }
  R interface { Get(id string) (*User, error); Other }
)
type G[T any] struct { v T }
func (g *G[T]) Do(a int,
  b string) (T, error) { return "}" }
""",
    "r.rs": """#[derive(Debug)]
pub struct Q { a: u8, pub(crate) b: HashMap<String, Vec<u8>> }
pub struct W(pub u8, String);
enum E { X, Y(u32), Z { a: u8 } }
impl<T> fmt::Display for Q where T: X { fn fmt(&self, f: &mut F<'_>) -> fmt::Result { let s = r#"}"#; } }
impl Q { pub async fn go<T>(&self, x: T) -> Result<(), E> { /* } /* } */ */ 1 } }
pub trait Repo: Clone { fn save(&self, o: Order) -> Result<(), E>; }
""",
}

#: Of each class: module, bases, attributes, methods.
WANT = {
    "Dog": ("Root", ["Animal", "Pet", "Toy"], ["Map<String, List<Integer>> m", "int a"], ["load(int a, Map<String, T> b)"]),
    "Inner": ("Root", [], ["int z"], []),
    "P": ("Root", [], ["int a", "Map<String, List<Integer>> m"], []),
    "S": ("Uni.Structures", ["Base", "IThing"], ["int a", "int Id", "List<List<int>> Xs"], ["Load(int a)"]),
    "ITree": ("Uni.Structures", ["IBase"], ["int Count"], ["Get(int at)"]),
    "Node": ("Uni.Structures", [], ["int Id", "string? N"], []),
    "A": ("App\\Models", ["\\Foo\\Bar", "I", "J"], ["?int $x", "(B&C)|null $y", "string $n", "string $m", "$q"], ["__construct(private readonly ?int $x, protected (B&C)|null $y = null, $z = 1)"]),
    "Suit": ("App\\Models", ["HasL"], [], ["label()"]),
    "T": ("Root", ["Base", "A", "B"], ["x: Map<string, number>", "y: string", "z", "http: Client<Foo, Bar>", "handle"], ["constructor(private readonly http: Client<Foo, Bar>, other: number)", "name()", "load(a: T, b = {c: 1})"]),
    "Props": ("Root", [], ["a: string", "b: number", "d: object"], ["c(x: number): void"]),
    "Config": ("Root", [], ["debug: boolean", "list: Array<Map<string, X>>"], []),
    "Card": ("Root", [], [], ["render({ a, b }: Props)"]),
    "Panel": ("Root", [], [], ["render({ a })"]),
    "GET": ("Root", [], [], ["handler(req: Request)"]),
    "go A": ("Root", [], ["int B", "int C", "*pkg.Base", "map[string]*User m"], []),
    "R": ("Root", [], [], ["Get(id string) (*User, error)", "Other"]),
    "G": ("Root", [], ["T v"], ["Do(a int, b string) (T, error)"]),
    "Q": ("Root", [], ["a: u8", "b: HashMap<String, Vec<u8>>"], ["fmt(&self, f: &mut F<'_>) -> fmt::Result", "go(&self, x: T) -> Result<(), E>"]),
    "W": ("Root", [], ["0: u8", "1: String"], []),
    "E": ("Root", [], ["variant X", "variant Y", "variant Z"], []),
    "Repo": ("Root", ["Clone"], [], ["save(&self, o: Order) -> Result<(), E>"]),
}


def test_classes_of_many_shapes(spark):
    found = structure.brace_classes(from_rows(spark, FILES)).collect()
    got = {("go A" if (r["language"], r["name"]) == ("go", "A") else r["name"]): (r["module"], r["bases"], r["attributes"], r["methods"]) for r in found}
    assert got == WANT
    assert {r["name"] for r in found if r["is_interface"]} == {"ITree", "Props", "R", "Repo"}


@pytest.mark.parametrize("depth", [3, 40])
def test_ddl_of_any_depth(spark, depth):
    deep = "f(" * depth + "1" + ")" * depth
    text = f"""-- c
CREATE TABLE IF NOT EXISTS public."my t" (
 id INT, b DECIMAL(10, 2) DEFAULT ({deep}) NOT NULL, -- x, y
 c INT REFERENCES other(id), d text CHECK (a < (b)),
 CONSTRAINT pk PRIMARY KEY (id, b), FOREIGN KEY (d) REFERENCES s.third(x)
);
create table t2 (x int primary key)
"""
    found = {tuple(r) for r in entities.ddl(from_rows(spark, {"x.sql": text}), 0).select("entity", "name", "type", "is_pk", "target", "label").collect()}
    assert found == {
        ("my t", "id", "INT", True, None, None),
        ("my t", "b", "DECIMAL(10, 2)", True, None, None),
        ("my t", "c", "INT", False, None, None),
        ("my t", "d", "text", False, None, None),
        ("my t", None, None, False, "other", "c"),
        ("my t", None, None, False, "third", "d"),
        ("t2", "x", "int", True, None, None),
    }


def test_models_by_syntax_tree(spark):
    text = """import sqlalchemy as sa
from sqlalchemy import Column as C, ForeignKey
type UserId = int
class A(Base):
    id: Mapped[UserId] = mapped_column(primary_key=True)
    name = C(
        sa.String(20),
        nullable=False,
    )
    owner_id = sa.Column(sa.Integer, ForeignKey(
        "public.users.id"))
    posts: Mapped[list["Post"]] = relationship(
        back_populates="a")
    one = relationship("B", uselist=False)
    opt: Mapped["Optional[str]"]
class D(models.Model):
    owner = models.ForeignKey(
        "auth.User", on_delete=models.CASCADE)
"""
    files = from_rows(spark, {"x.py": text, "bad.py": "class A(Base:\n  x = 1"})
    found = {tuple(r) for r in entities.python_models(files, 0).select("entity", "name", "type", "is_pk", "target", "symbol", "label").collect()}
    assert found == {
        ("A", "id", "int", True, None, None, None),
        ("A", "name", "String", False, None, None, None),
        ("A", "owner_id", "Integer", False, None, None, None),
        ("A", None, None, False, "users", "}o--||", "owner_id"),
        ("A", None, None, False, "Post", "||--o{", "posts"),
        ("A", None, None, False, "B", "||--||", "one"),
        ("A", "opt", "str", False, None, None, None),
        ("D", None, None, False, "User", "}o--||", "owner"),
    }


def test_objects_of_any_depth(spark):
    text = """export const userSchema = new mongoose.Schema<IUser>({
  name: { type: String,
     required: true },
  posts: [{ type: Schema.Types.ObjectId, ref: 'Post' }],
  address: { street: { city: { zip: { a: { b: String } } } } },
}, { timestamps: true });
const U = sequelize.define('U', { id: { type: DataTypes.INTEGER, primaryKey: true }, n: DataTypes.STRING }, {});
U.belongsTo(models.Team, { as: 'x' });
export const z = pgTable("zed", { id: serial('id').primaryKey(), o: integer('o')
   .references(() => other.id) });
"""
    found = entities.script_schemas(from_rows(spark, {"package.json": '{"mongoose": 1}', "m.ts": text}), 0)
    assert {tuple(r) for r in found.select("entity", "name", "type", "is_pk", "target", "label").collect()} == {
        ("User", "name", "String", False, None, None),
        ("User", "address", "Object", False, None, None),
        ("User", None, None, False, "Post", "posts"),
        ("U", "id", "INTEGER", True, None, None),
        ("U", "n", "STRING", False, None, None),
        ("U", None, None, False, "Team", "belongsTo"),
        ("zed", "id", "serial", True, None, None),
        ("zed", "o", "integer", False, None, None),
        ("zed", None, None, False, "other", "o"),
    }


def test_brackets_as_a_stack_has_them(spark):
    """Depth and block of each token, against a stack over the scanned tokens."""
    found = nested(tokens(from_rows(spark, FILES))).collect()
    for path, source in FILES.items():
        language = next(r["language"] for r in found if r["path"] == path)
        stack, want = [], []
        for i, text in enumerate(source[a:b] for kind, a, b in scanned(source, language) if kind != "comment"):
            if text in (")", "]", "}"):
                stack.pop()
            want.append((i, text, len(stack), stack[-1] if stack else -1))
            if text in ("(", "[", "{"):
                stack.append(i)
        assert sorted((r["i"], r["text"], r["depth"], r["block"]) for r in found if r["path"] == path) == want


@pytest.mark.parametrize(
    ("language", "source", "code"),
    [
        ("rust", "a /* x /* y */ { */ b r#\"\"}\"# 'c' &'d e", ["a", "b", "&", "'d", "e"]),
        ("script", "r = /[/}]/g; t = `a${ {x: `}`} }b`; 4 / 2 / 1 // }", ["r", "=", ";", "t", "=", ";", "4", "/", "2", "/", "1"]),
        ("csharp", 's = @"a""{"; $"{x}" """ " { """ 1', ["s", "=", ";", "1"]),
        ("php", "<?php $a = <<<'E'\n { \n E; # {\n #[B] '{' ?> class { <?php c", ["$a", "=", ";", "#", "[", "B", "]", "c"]),
        ("java", '@A("{") x = """\n " { """; // {', ["@A", "(", ")", "x", "=", ";"]),
        ("go", "`{\n` '{' \"\\\"{\" /* { */ x", ["x"]),
    ],
)
def test_masked(language, source, code):
    plain = masked(source, language)
    assert len(plain) == len(source) and plain.count("\n") == source.count("\n")
    assert [plain[a:b] for kind, a, b in scanned(source, language) if kind not in ("comment", "string")] == code
    assert all(not plain[a:b].strip() for kind, a, b in scanned(source, language) if kind in ("comment", "string"))


def test_parsed_tables_are_dealt_by_bytes_and_not_broadcast(spark):
    """Tokens compress so well that by their size in a file or a shuffle they were broadcast, and few tasks got all."""
    from sediment.shared import dealt

    files = from_rows(spark, {f"a/C{k}.cs": f"public class C{k} : B {{ public int Id {{ get; set; }} public void Run(int x) {{ }} }}\n" for k in range(40)})
    of = structure.Parsed(files)
    of.rows, of.heads, of.source  # noqa: B018 - written before the plan that reads them
    found = structure.brace_classes(of, "csharp")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 40
    assert structure.tokens(files, 7).rdd.getNumPartitions() == 7
    assert dealt(0, 8) == 1 and dealt(1 << 18, 8) == 4 and dealt(60 << 20, 8) == 120 and dealt(360 << 20, 8) == 720


def test_members_are_gathered_in_dealt_tasks(spark):
    """The lists of members go to as many tasks as the source asks for: compressed bytes would merge them into few."""
    files = from_rows(spark, {f"a/J{k}.java": f"class J{k} extends B {{ int a{k}; void run(int x) {{ }} }}\n" for k in range(40)})
    of = structure.Parsed(files)
    of.__dict__["parts"] = 7
    found = structure.brace_classes(of, "java")
    assert found.rdd.getNumPartitions() == 7
    assert sorted((r["name"], r["attributes"], r["methods"]) for r in found.collect()) == sorted((f"J{k}", [f"int a{k}"], ["run(int x)"]) for k in range(40))
