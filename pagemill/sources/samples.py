"""Small documents that show what the operators tell apart."""

from __future__ import annotations

SAMPLES = {
    "page": '<!DOCTYPE html><html><head><title>A &amp; B</title></head><body class="x"><p>one<br>two</p></body></html>',
    "references": "<p>&lt;tag&gt; &copy; &#65; &#x42; &middot; &amp</p>",
    "attributes": "<input type=text value='a&amp;b' disabled type=hidden />",
    "comment": "<p>a<!-- note --!>b</p><!bogus>",
    "script": "<script>if (a<b) { say('</p>'); }</script><p>after</p>",
    "escaped script": "<script><!-- <script> x </script> --></script>",
    "cdata": "<p>x<![CDATA[<raw>&amp;]]>y</p>",
    "unclosed": '<div a="1',
}
