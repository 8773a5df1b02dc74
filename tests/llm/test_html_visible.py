import pytest

from ledgerlight.llm import html


@pytest.mark.parametrize("page, text", [
    ("a <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></math> b", "a x= 1 2 b"),
    ("<math><semantics><mi>y</mi><annotation>no</annotation></semantics></math>", "y"),
    ("a<svg><title>no</title><desc>no</desc><defs><text>no</text></defs>no<g><path d='M0'/><text x=1>Q<tspan>1</tspan></text><text>Q2</text></g></svg>b", "a Q1 Q2 b"),
    ("<svg><defs/><title/><text>seen</text><text display=none>no</text></svg>", "seen"),
    ("<svg><foreignObject><div>in</div></foreignObject></svg>x", "in\nx"),
    ("<svg><path><p>after", "after"),
    ("<table><tr><td>a</td></tr><tfoot>loose<tr><td>f</td></tr><div>more</div></tfoot></table>", "loose\nmore\na\nf"),
])
def test_all_visible_text(page, text):
    assert html.page_text(page)[1] == text
