from decimal import Decimal

import pytest

from quincunx.plans.program import (
    Discrete,
    Normal,
    ProgramError,
    Uniform,
    read_formula,
    read_program,
    scan,
)

TAIL = r"\iter{100}\response{avg}"


def codes(text, reader=read_program):
    with pytest.raises(ProgramError) as caught:
        reader(text)
    return [d.code for d in caught.value.diagnostics]


@pytest.mark.parametrize(
    "text, sql",
    [
        ("2x", "(2.0D * v0)"),
        ("a/2b", "((v0 / 2.0D) * v1)"),
        ("-a^2", "(-power(v0, 2.0D))"),
        ("a-b-c", "((v0 - v1) - v2)"),
        ("a+b*c", "(v0 + (v1 * v2))"),
        ("a*-b", "(v0 * (-v1))"),
        ("{-{-x}}", "(-(-v0))"),
        ("x{y+1}", "(v0 * (v1 + 1.0D))"),
        ("x^-1.5", "power(v0, (-1.5D))"),
        (r"2\sqrt{x}", "(2.0D * sqrt(v0))"),
        ("x y^2", "(v0 * power(v1, 2.0D))"),
        (".5+x", "(0.5D + v0)"),
        ("avg+min", "(v0 + v1)"),
    ],
)
def test_formula_text(text, sql):
    assert read_formula(text).branches == (sql,)


def test_names_differ_by_case_and_keep_their_order():
    assert read_formula("b+B+a+b").names == ("b", "B", "a")


def test_repeated_operands_become_steps():
    formula = read_formula(r"\frac{a+b}{c-d}")
    assert [sql for _, sql in formula.steps] == ["(v0 + v1)", "(v2 - v3)"]


def test_fork_passes_through_its_parents():
    formula = read_formula(r"2{a\pm1}")
    assert formula.branch_ids == ("plus", "minus")
    assert formula.branches == ("(2.0D * (v0 + 1.0D))", "(2.0D * (v0 - 1.0D))")


@pytest.mark.parametrize("text", [r"a\pm1", r"a\pm\sqrt{b}", r"a\pm b"])
def test_fork_before_a_non_letter(text):
    assert len(read_formula(text).branches) == 2


@pytest.mark.parametrize(
    "text, code",
    [
        (r"base\pmajuste", "LEX001"), (r"\modelx", "LEX001"), ("a+\\", "LEX002"), ("01", "LEX003"), ("00", "LEX003"),
        ("5.", "LEX003"), (".", "LEX003"), ("1.2.3", "LEX003"), ("(a)", "LEX005"), ("[a]", "LEX005"), ("a@b", "LEX005"),
        ("a;b", "LEX005"), ("--x", "SYN041"), ("2 3", "SYN042"), ("a^b", "SYN001"), ("a^{2}", "SYN001"),
        ("x^2^3", "SYN001"), ("{a", "SYN001"), ("x/0", "SEM050"), (r"\frac{1}{2-2}", "SEM050"),
        (r"\sqrt{-1}", "SEM051"), ("0^-1", "SEM052"), (r"a\pm b\pm c", "SEM040"), ("a+" + "9" * 400, "GEN001"),
        ("a+0." + "0" * 400 + "1", "GEN004"),
    ],
)
def test_formula_diagnostics(text, code):
    assert codes(text, read_formula) == [code]


def test_fractional_power_of_a_negative_constant_is_left_to_the_run():
    read_formula("a+{-1}^0.5")


@pytest.mark.parametrize(
    "text, expected",
    [
        (r"\model{y=x}\iter{1}\response{avg}", ["SYN010"]),
        (r"\model{y=x}\response{avg}", ["SYN011"]),
        (r"\model{y=x}\distrib x{}" + TAIL, ["SYN020"]),
        (r"\model{y=x}\distrib x{{1,.5},}" + TAIL, ["SYN021"]),
        (r"\model{y=x}\distrib x{{1,.5}{2,.5}}" + TAIL, ["SYN022"]),
        (r"\model{y=x}\normal x{0,1}\iter{1}\response{}", ["SYN030"]),
        (r"\model{y=x}\normal x{0,1}\iter{1}\response{median}", ["LEX007"]),
        (r"\model{y=x}\normal x{0,1}\iter{1}\response{avg;}", ["LEX006"]),
        (r"\model{y=a}\normal b{0,1}" + TAIL, ["SEM003", "SEM005"]),
        (r"\model{y=x}\normal y{0,1}\normal x{0,1}" + TAIL, ["SEM001"]),
        (r"\model{y=y+x}\normal x{0,1}" + TAIL, ["SEM002"]),
        (r"\model{y=x}\normal x{0,1}\uniform x{0,1}" + TAIL, ["SEM004"]),
        (r"\model{y=x}\normal y{0,1}" + TAIL, ["SEM001", "SEM006", "SEM003"]),
        (r"\model{y=x}\normal x{0,0}" + TAIL, ["SEM010"]),
        (r"\model{y=x}\uniform x{2,2}" + TAIL, ["SEM011"]),
        (r"\model{y=x}\distrib x{{1,1.5}}" + TAIL, ["SEM012", "SEM013"]),
        (r"\model{y=x}\distrib x{{1,.5},{2,.4}}" + TAIL, ["SEM013"]),
        (r"\model{y=x}\distrib x{{1,.5},{1.0,.5}}" + TAIL, ["SEM014"]),
        (r"\model{y=x}\normal x{0,1}\iter{1.5}\response{avg}", ["SEM020"]),
        (r"\model{y=x}\normal x{0,1}\iter{0}\response{avg}", ["SEM021"]),
        (r"\model{y=x}\normal x{0,1}\iter{1}\response{avg,avg}", ["SEM030"]),
        (r"\model{y=x}\uniform x{1,1.00000000000000000001}" + TAIL, ["GEN005"]),
        (r"\model{y=x}\distrib x{{1,.5},{1.00000000000000000001,.5}}" + TAIL, ["GEN006"]),
    ],
)
def test_program_diagnostics(text, expected):
    assert codes(text) == expected


def test_a_whole_program():
    program = read_program(
        "\\model{r=x\\pm z w}\n\\normal x{-1,+2}\n\\uniform z{-20,30}\n"
        "\\distrib w{{10,0.5},{15,0.3},{20,0.2}}\n\\iter{2000}\n\\response{max,avg,min}\n"
    )
    assert program.output == "r"
    assert dict(program.variables) == {
        "x": Normal(-1.0, 2.0), "z": Uniform(-20.0, 30.0), "w": Discrete((10.0, 15.0, 20.0), (0.5, 0.3, 0.2)),
    }
    assert list(program.variables) == ["x", "z", "w"]
    assert (program.iterations, program.response) == (2000, ("max", "avg", "min"))


def test_programs_have_no_size_limit():
    text = r"\model{y=x" + "+x" * 40_000 + r"}\normal x{0,1}\iter{20000000000}\response{avg}"
    assert read_program(text).iterations == 20_000_000_000


def test_probabilities_are_summed_exactly():
    tenth = ",".join(f"{{{k},0.1}}" for k in range(10))
    read_program(r"\model{y=x}\distrib x{" + tenth + "}" + TAIL)
    assert sum([Decimal("0.1")] * 10) == 1


def test_diagnostic_position():
    with pytest.raises(ProgramError) as caught:
        read_program("\\model{y=x+\n  q}\n\\normal x{0,1}\n" + TAIL)
    (problem,) = caught.value.diagnostics
    assert (problem.code, problem.line, problem.column, problem.lexeme, problem.phase) == (
        "SEM003", 2, 3, "q", "SEMANTIC",
    )


def test_statistic_names_are_special_in_the_response_only():
    kinds = [t.kind for t in scan(r"avg\response{avg}avg")]
    assert kinds == ["name", "directive", "symbol", "statistic", "symbol", "name", "end"]
