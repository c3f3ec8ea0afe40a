"""Sources as they are written in earnest: no false errors, and the constructs have their nodes."""

import pytest

from treeloom.operators.nodes import parse_one
from treeloom.operators.parsers.base import sexp

SOURCES = {
    "toml": [("# parts\na = 0x1F\n'b c'.d = \"x\\u00e9\"\n[t.\"u v\"]\nlong = \"\"\"\none\ntwo\"\"\"\nat = [1979-05-27T07:32:00Z, 07:32:00] # last\n[[e]]\nf = {g = [ {h = -1.5e3}, ], i = inf}\n", "offset_date_time")],
    "css": [("@import url('a.css') screen;\n@media (min-width: 30em) and (orientation: landscape) {\n  .a > li + li ~ p::first-line, [href^=\"x\"] { color: #0af; margin: -1px auto 0 .5em !important }\n}\n@keyframes spin { from { top: 0 } 50%, 75% { top: 1px } to { top: 2px } }\n:root { --main: rgba(0, 0, 0, .5) }\n.card { &:hover { width: calc(100% - (2px * 3)) } a:not(.b):nth-child(2n+1) { background: url(a/b.png?c=d) } }\n", "keyframes_statement")],
    "python": [
        ("class Box[Item: Hashable](Base[Item]):\n    async def fill[**P, *Rest, Other = int](self, first: Item, *, second: Other | None = None) -> dict[str, Item]:\n        return {k: v async for k, v in first if v is not None}\n", "type_parameter"),
        ("with open(a) as f, open(b) as g:\n    x: list[int] = [*map(int, f), *g]\n    y = lambda *q, **r: (q, r)\nmatch = 3\n", "with_statement"),
    ],
    "typescript": [
        ("type Props = Outer<'row'> & {\n  side?: 'left' | 'right';\n  readonly sizes: Array<[number, string]>;\n  [key: string]: unknown;\n  pick(a: number, b?: string): Promise<void>;\n};\n", "object_type"),
        ("export const run = async <T,>(x: T, { deep = false, ...rest }: { deep?: boolean } & Rest = {}): Promise<T> => {\n  return rest?.call?.(x) ?? list?.[0];\n};\n", "arrow_function"),
        ("abstract class Shape<T extends object> extends Base<T> implements A, B {\n  private readonly cache = new Map<string, T>();\n  constructor(public name: string) { super(); }\n  get size(): number { return this.cache.size; }\n  static of(x?: number): Shape<any> | undefined { return undefined; }\n}\n", "class_heritage"),
    ],
    "tsx": [
        ("export function Card({ title, ...props }: { title?: string } & Box<'div'>) {\n  return (\n    <div className=\"card\" {...props}>\n      {/* it's a note */}\n      Don't stop // here\n      {open && <Icon.Large size={3} label='x' disabled />}\n      <>\n        {items.map((x) => (\n          <li key={x.id} onClick={() => pick?.(x)}>{x.name}</li>\n        ))}\n      </>\n    </div>\n  );\n}\nconst after = 1;\n", "jsx_element"),
        ("const One = () => <b>hi</b>;\nconst two = <data-row a-b=\"1\" xlink:href={u}/>;\n", "jsx_self_closing_element"),
    ],
    "javascript": [("const v = cond ? <p>yes</p> : <p>no</p>;\nfor (const [k, w] of Object.entries(v)) { label: while (1) { break label; } }\n", "jsx_element")],
    "rust": [
        ("fn f(x: Kind) -> Option<&'static str> {\n    match x {\n        Kind::Off => None,\n        Kind::A | Kind::B(1..=5) if ready() => Some(\"ab\"),\n        Kind::C { a, .. } => { run(a)?; Some(\"c\") }\n        _ => list.iter().map(|t| t.clamp(0.0, 1.0)).filter(|(a, _)| *a > 1).next().or_else(|| None),\n    }\n}\n", "match_arm"),
        ("impl<'a, T: Clone + Send> Holder<'a, T> where T: Default {\n    pub async fn get(&mut self) -> Result<Vec<T>, Box<dyn Error>> {\n        let Self { a, b } = self;\n        Ok(vec![a.clone(); 3])\n    }\n}\n", "impl_item"),
    ],
    "go": [
        ("package p\n\nfunc Open(name string, opts ...Option) (*File, error) {\n\tf, err := os.Open(name)\n\tif err != nil {\n\t\treturn nil, fmt.Errorf(\"open %s: %w\", name, err)\n\t}\n\tif v, ok := cache[name]; ok && v.live {\n\t\treturn v, nil\n\t}\n\ta, b = b, a+1\n\tfor k, w := range m {\n\t\tgo func() { out <- pair{k, w} }()\n\t}\n\tp := *(**C.char)(unsafe.Pointer(q))\n\treturn f, nil\n}\n", "expression_list"),
        ("package p\n\nvar a, b = 1, 2\n\nfunc (s *Set[T]) Add(x T) bool {\n\tswitch v := x.(type) {\n\tcase int, string:\n\t\treturn true\n\tdefault:\n\t\treturn v != nil\n\t}\n}\n", "method_declaration"),
    ],
}


@pytest.mark.parametrize("language,text,kind", [(k, t, what) for k, v in SOURCES.items() for t, what in v])
def test_no_false_errors(language, text, kind):
    c = parse_one(language, text.encode())
    bad = [(c["kind"][i], text.encode()[c["start_byte"][i] : c["end_byte"][i]]) for i in range(len(c["kind"])) if c["is_error"][i] or c["is_missing"][i]]
    assert bad == [] and kind in c["kind"]
    for i, p in enumerate(c["parent_id"]):  # every node lies within its parent
        assert p is None or c["start_byte"][p] <= c["start_byte"][i] <= c["end_byte"][i] <= c["end_byte"][p]


def test_text_of_elements_is_text():
    text = "const a = <p title='t'>it's {name} // no remark<br/>&amp; \"quoted\"</p>; // remark\nconst b = 'x';\n"
    c = parse_one("tsx", text.encode())
    at = [text[s:e] for k, s, e in zip(c["kind"], c["start_byte"], c["end_byte"]) if k == "jsx_text"]
    assert at == ["it's ", " // no remark", '&amp; "quoted"']
    assert [text[s:e] for k, s, e in zip(c["kind"], c["start_byte"], c["end_byte"]) if k == "comment"] == ["// remark"]
    assert c["kind"].count("lexical_declaration") == 2


def test_errors_are_still_found():
    for language, text in (("tsx", "const a = <p>x</q"), ("tsx", "const a = <p"), ("go", "package p\nfunc f() { return a, }}\n"), ("rust", "fn f() { match x { A => 1 B ) } }"), ("python", "class A[T(:\n    pass\n")):
        c = parse_one(language, text.encode())
        assert any(c["is_error"]) or any(c["is_missing"]), text
    for language, text in (("toml", "a = \n"), ("toml", "[t\n"), ("toml", "a = [1, 2\n"), ("toml", "??\n"), ("css", "a { color: red"), ("css", "a } b {}"), ("css", "> {"), ("css", "a { b: 'c\n }")):
        c = parse_one(language, text.encode())
        assert any(c["is_error"]) or any(c["is_missing"]), text


@pytest.mark.parametrize("language,text", [("python", "x = " + "(" * 3000 + "1" + ")" * 3000 + "\n"), ("javascript", "x = " + "[" * 3000 + "]" * 3000 + ";"), ("json", "[" * 50_000 + "]" * 50_000), ("toml", "a = " + "[" * 20_000 + "]" * 20_000 + "\n"), ("css", "a { " * 20_000 + "}" * 20_000), ("css", "a { b: " + "f(" * 20_000 + ")" * 20_000 + " }")])
def test_deep_nesting_keeps_its_tree(language, text):
    c = parse_one(language, text.encode())
    assert max(c["depth"]) >= 3000 and not any(c["is_error"]) and not any(c["is_missing"])
    assert sexp(c).count("(") >= 3000
