import random
import string

import pytest

from rillwork.llm import op4_surrogates as op4


def found(text):
    return [text[s:e] for s, e, _, _ in op4.entities(text)]


@pytest.mark.parametrize("head, n", [("token=", 400), ("token=", 200_000), ("secret: ", 300)])
def test_secrets_go_to_their_end(head, n):
    rng = random.Random(n)
    value = "".join(rng.choice(string.ascii_letters + string.digits + "._-") for _ in range(n))
    text, _ = op4.replaced(f"see {head}{value} end", op4.KEY, {}, {})
    new = text[len(f"see {head}") : -4]
    assert len(new) == n and all(value[i : i + 40] not in text for i in range(0, n - 40, 20))
    other = value[:-1] + ("b" if value[-1] != "b" else "c")
    assert op4.surrogate(op4.KEY, "secret", other) != op4.surrogate(op4.KEY, "secret", value)


def test_keys_of_any_length():
    for head in ("sk-", "ghp_", "xoxb-"):
        value = head + "Ab3" * 200
        assert found(f"key {value}.") == [value]


def test_possessives_and_hyphens():
    assert found("Mary Smith called. Mary's book, Mary’s dog, Smith-Jones and Smith.") == ["Mary", "Smith", "Mary", "Mary", "Smith", "Smith"]
    assert found("Mr Keller's car; Keller left") == ["Keller", "Keller"]
    assert found("“Anna”—she said") == ["Anna"] and found("Anna-Maria") == ["Anna", "Maria"] and found("Frau Berg. г-н Иванов") == ["Berg", "Иванов"]


def test_compressed_ipv6():
    assert found("at fe80::1 and 2001:db8::8a2e:370:7334, ::1.") == ["fe80::1", "2001:db8::8a2e:370:7334", "::1"]
    assert found("a std::vector, x :: y, ::ffff:10.1.2.3") == ["10.1.2.3"]
    assert found("1:2:3:4:5::6:7:8:9") == []
