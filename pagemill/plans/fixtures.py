"""Golden cases: documents, how they are parsed, and what must come out, as one line of text each.

A line shows tokens: <tag a="v"> and </tag> (/> if self-closing), {comment}, !name|public|system|quirks,
"text" for characters; then the final state after @ where a case forces its first state. NUL is shown as \\0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import preprocess
from ..operators.lex import build_tree, lexed, tokenize, trace_runs
from ..operators.relational import coalesce_runs, ordered_text, pretty, shape
from ..operators.sanitize import parse_in_contexts, sanitize

#: name -> html, expected line.
TEXT = {
    'plain prose': ("Seven geese crossed the pond at noon.", '"Seven geese crossed the pond at noon."'),
    'nothing': ("", ""),
    'named with and without end': ("salt &amp pepper &amp; oil &lt; vinegar &gt;vinegar", '"salt & pepper & oil < vinegar >vinegar"'),
    "names that aren't known": ("a &pebble; b &Pebble; c &times; d", '"a &pebble; b &Pebble; c × d"'),
    'longest known prefix': ("&ltd&ampere;&gtr&quoth;", '"<d&ere;>r"h;"'),
    'cut off at the end': ("tea &a", '"tea &a"'),
    'ampersands in odd places': ("R&D && Q&A & &. &\tend&", '"R&D && Q&A & &. &\tend&"'),
    'decimal, hex, both cases': ("&#72;&#x65;&#X6C;&#x6c;&#111;&#x21", '"Hello!"'),
    'number ends at a letter': ("&#57z &#x3Ag", '"9z :g"'),
    'digits missing': ("&# &#; &#x &#x; &#xyz &#-1;", '"&# &#; &#x &#x; &#xyz &#-1;"'),
    "numbers that aren't characters": ("&#0;|&#x110000;|&#xD800;|&#57343;|&#99999999999999999999;", '"�|�|�|�|�"'),
    'windows code points': ("&#130;&#132;&#133;&#145;&#146;&#147;&#148;&#151;&#153;&#159;", '"‚„…‘’“”—™Ÿ"'),
    'control and private numbers': ("&#1;&#xB;&#127;&#129;&#xE000;&#xFFFE;", '\x0b\x7f\x81\ue000\ufffe"'),
    'beyond the basic plane': ("&#x1F99A;&#129419; and 🐝 itself", '"🦚🦋 and 🐝 itself"'),
    'spaces and signs': ("&nbsp;&copy;&reg;&quot;&apos;", "\"\xa0©®\"'\""),
    'equals sign and digits after a name': ("x&lt=1&gt2&amp=&amp3", '"x<=1>2&=&3"'),
    'nul among letters': ("ab\0\0cd&amp;\0", '"ab\\0\\0cd&\\0"'),
    'less-than that opens nothing': ("3 < 4 <5 <= 6 << 7 <", '"3 < 4 <5 <= 6 << 7 <"'),
}
TAGS = {
    'nested with text': ("<menu>soup<li>bread</li></menu>", '<menu>"soup"<li>"bread"</li></menu>'),
    'names folded, others not': ("<ArTicle><SECTION></Section></aRTICLE><É>", '<article><section></section></article>"<É>"'),
    'names with digits and marks': ("<h2><x-y.z_1></x-y.z_1></h2>", "<h2><x-y.z_1></x-y.z_1></h2>"),
    'nul in a name and in an attribute': ("<ol\0x q\0r='s\0t' u=v\0w>", '<ol�x q�r="s�t" u="v�w">'),
    'white space everywhere': ("<p\n\tid\f=\n'k'\t\n lang \t=\f de  >", '<p id="k" lang="de">'),
    'three ways to quote': ("<i a='1 \"2\"' b=\"3 '4'\" c=5`6>", "<i a=\"1 \"2\"\" b=\"3 '4'\" c=\"5`6\">"),
    'no value, empty value': ("<input checked value='' name=\"\" hidden>", '<input checked="" value="" name="" hidden="">'),
    'the first of equal names stays': ("<td col=1 COL=2 Col='3' row=4>", '<td col="1" row="4">'),
    'self-closing and a stray solidus': ("<hr/><img src=a/b/ /><a /x/y='z'/>", '<hr/><img src="a/b/"/><a x="" y="z"/>'),
    'signs at the start of a name': ("<b =c =d=e 'f \"g <h>", "<b =c=\"d=e\" 'f=\"\" \"g=\"\" <h=\"\">"),
    'no space after a quote': ("<u a='1'b=\"2\"c/>", '<u a="1" b="2" c=""/>'),
    'value missing or started oddly': ("<s a= ><s b=<c><s d==e><s f=`g h='i'>", '<s a=""><s b="<c"><s d="=e"><s f="`g" h="i">'),
    'references in values': ("<q a='&lt;&#33;' b=\"&quot;&ampx\" c=&gt;&copy;>", '<q a="<!" b=""&ampx" c=">©">'),
    "names that don't count in values": ("<a href='?x=1&lt=2&copy=3&gt4&amp;y&amp'>", '<a href="?x=1&lt=2&copy=3&gt4&y&">'),
    'lone ampersands in values': ("<a b='&' c=\"& &\" d=& e=&>", '<a b="&" c="& &" d="&" e="&">'),
    'quotes end a reference': ("<a b='&#39;&' c=\"&#34;&\">", "<a b=\"'&\" c=\"\"&\">"),
    'end tags with more than a name': ("</p class='x'></div/></td id=1 id=2 />", '</p class="x"></div></td id="1">'),
    'end tags without a name': ("a</>b</ >c</9>d</!e>f", '"ab"{ }"c"{9}"d"{!e}"f"'),
    'cut in a name': ("kept<sect", '"kept"'),
    'cut before a name': ("kept<", '"kept<"'),
    'cut after a solidus': ("kept</", '"kept</"'),
    'cut before, in and after an attribute': ("kept<p ", '"kept"'),
    "cut in an attribute's name": ("kept<p cla", '"kept"'),
    'cut in a quoted value': ("kept<p class='op", '"kept"'),
    'cut in an open value': ("kept<p class=op", '"kept"'),
    'cut after a quote': ("kept<p class='op'", '"kept"'),
    'cut in a self-closing tag': ("kept<p /", '"kept"'),
    "pure: tags don't change the text after them": ("<title>x<b></title><style>p<q</style><textarea>&lt;", '<title>"x"<b></title><style>"p"<q< style=""><textarea>"<"'),
    'pure: a script is markup': ("<script>let s = 1 <b && 'x';</script>", "<script>\"let s = 1 \"<b &&=\"\" 'x';<=\"\" script=\"\">"),
}
DECLARATIONS = {
    'comments in a row': ("<!--one--><!-- two - three --><!---->x<!-- -- -->", '{one}{ two - three }{}"x"{ -- }'),
    'ended at once': ("<!-->a<!--->b", '{}"a"{}"b"'),
    'many dashes': ("<!----->a<!--b---->c<!-----d-->", '{-}"a"{b--}"c"{---d}'),
    'bangs': ("<!--a--!>b<!--c--!d--><!--e--!-->f<!----!>g", '{a}"b"{c--!d}{e--!}"f"{}"g"'),
    'less-than inside': ("<!--a<b<!--c--><!--<!-->", "{a<b<!--c}{<!}"),
    'nul inside': ("<!--\0a-\0b--\0c--!\0-->", "{�a-�b--�c--!�}"),
    'open comment': ("x<!--never", '"x"{never}'),
    'open after a dash': ("x<!--never-", '"x"{never}'),
    'open after two': ("x<!--never--", '"x"{never}'),
    'open after a bang': ("x<!--never--!", '"x"{never}'),
    'open at the start': ("x<!--", '"x"{}'),
    'open at the start, one dash': ("x<!---", '"x"{}'),
    'bogus ones': ("<!note><?php echo 1 ?></*x*><!-x><!>y", '{note}{?php echo 1 ?}{*x*}{-x}{}"y"'),
    'nul in a bogus one': ("<!\0a\0>b", '{�a�}"b"'),
    'bogus at the end': ("x<!ELEMENT", '"x"{ELEMENT}'),
    'doctypes by case and space': ("<!DOCTYPE book><!docTYPE\n\tCaFe\f><!DOCTYPEnone>", "!book|-|-|false!cafe|-|-|false!none|-|-|false"),
    'public, double quotes': ("<!DOCTYPE a PUBLIC \"Pub 'X'\" \"sys\"><!DOCTYPE b pUbLiC \"p\">", "!a|Pub 'X'|sys|false!b|p|-|false"),
    'public, single quotes': ("<!DOCTYPE a PUBLIC 'Pub \"X\"' 'sys'><!DOCTYPE b PUBLIC 'p'>", '!a|Pub "X"|sys|false!b|p|-|false'),
    'public, mixed quotes': ("<!DOCTYPE a PUBLIC 'p'\"s\"><!DOCTYPE b PUBLIC \"p\" \t's' >", "!a|p|s|false!b|p|s|false"),
    'system, both quotes': ("<!DOCTYPE a SYSTEM 'it\"s'><!DOCTYPE b sYsTeM\n\"it's\" >", "!a|-|it\"s|false!b|-|it's|false"),
    'no space before a quote': ("<!DOCTYPE a PUBLIC'p''s'><!DOCTYPE b SYSTEM\"s\">", "!a|p|s|false!b|-|s|false"),
    'identifiers missing': ("<!DOCTYPE a PUBLIC><!DOCTYPE b PUBLIC ><!DOCTYPE c SYSTEM><!DOCTYPE d SYSTEM >", "!a|-|-|true!b|-|-|true!c|-|-|true!d|-|-|true"),
    'identifiers without quotes': ("<!DOCTYPE a PUBLIC p><!DOCTYPE b SYSTEM s><!DOCTYPE c PUBLIC 'p' s>", "!a|-|-|true!b|-|-|true!c|p|-|true"),
    'ended inside an identifier': ("<!DOCTYPE a PUBLIC 'p><!DOCTYPE b PUBLIC \"p><!DOCTYPE c SYSTEM 's><!DOCTYPE d SYSTEM \"s><!DOCTYPE e PUBLIC 'p' \"s>", "!a|p|-|true!b|p|-|true!c|-|s|true!d|-|s|true!e|p|s|true"),
    'nul in doctypes': ("<!DOCTYPE \0a><!DOCTYPE b\0 PUBLIC 'p\0' \"s\0\"><!DOCTYPE c SYSTEM 's\0'>", "!�a|-|-|false!b�|p�|s�|false!c|-|s�|false"),
    'no name': ("<!DOCTYPE><!DOCTYPE  >", "!-|-|-|true!-|-|-|true"),
    'something after': ("<!DOCTYPE a SYSTEM 's' t><!DOCTYPE b foo 'bar'><!DOCTYPE c publik 'p'>x", '!a|-|s|false!b|-|-|true!c|-|-|true"x"'),
    'cut: word': ("<!DOCTYPE", "!-|-|-|true"),
    'cut: name': ("<!DOCTYPE par", "!par|-|-|true"),
    'cut: after a name': ("<!DOCTYPE par ", "!par|-|-|true"),
    'cut: public keyword': ("<!DOCTYPE par PUBLIC", "!par|-|-|true"),
    'cut: before public': ("<!DOCTYPE par PUBLIC ", "!par|-|-|true"),
    'cut: public identifier': ("<!DOCTYPE par PUBLIC 'q", "!par|q|-|true"),
    'cut: after public': ("<!DOCTYPE par PUBLIC 'q'", "!par|q|-|true"),
    'cut: between': ("<!DOCTYPE par PUBLIC 'q' ", "!par|q|-|true"),
    'cut: system identifier': ("<!DOCTYPE par PUBLIC \"q\" 'r", "!par|q|r|true"),
    'cut: after system': ('<!DOCTYPE par SYSTEM "r"', "!par|-|r|true"),
    'cut: junk': ("<!DOCTYPE par junk", "!par|-|-|true"),
    'cdata': ("<![CDATA[5 < 6 &amp; ]] ]]]>x<![CDATA[]]>y<![cdata[z]]>", '"5 < 6 &amp; ]] ]xy"{[cdata[z]]}'),
    'cdata with nul, left open': ("<li><![CDATA[a\0b]]", '<li>"a\\0b]]"'),
}
#: name -> first state, last start tag, html, expected line with the final state.
FORCED = {
    'script text': ("SCRIPT_DATA", "script", "for (i=0;i<n;i++) s+='&lt;'</scripty></ script></SCRIPT >done<b>", "\"for (i=0;i<n;i++) s+='&lt;'</scripty></ script>\"</script>\"done\"<b>@Data"),
    'script with a comment': ("SCRIPT_DATA", "script", "<!--x-->y</script>z", '"<!--x-->y"</script>"z"@Data'),
    'script comment that hides an end': ("SCRIPT_DATA", "script", "<!--<script>a</script>b--></script>c", '"<!--<script>a</script>b-->"</script>"c"@Data'),
    'script comment with other tags': ("SCRIPT_DATA", "script", "<!-<!--<i>-<b->--<p></script>q", '"<!-<!--<i>-<b->--<p>"</script>"q"@Data'),
    'script nul and end': ("SCRIPT_DATA", "script", "\0<!--\0-\0--\0<script>\0-\0--\0", '"\\0<!--\\0-\\0--\\0<script>\\0-\\0--\\0"@Script data double escaped'),
    'escaped, then done': ("SCRIPT_DATA_ESCAPED", "script", "a-b--c---></script\n>d", '"a-b--c--->"</script>"d"@Data'),
    'escaped end with attributes': ("SCRIPT_DATA_ESCAPED", "script", "x</script type='y'/>z", '"x"</script type="y">"z"@Data'),
    'escaped, other names': ("SCRIPT_DATA_ESCAPED", "script", "</div></script1></sCRIPT/></script", '"</div></script1>"</script>@Tag name'),
    'escaped less-than': ("SCRIPT_DATA_ESCAPED_LESS_THAN_SIGN", "script", "5<6", '"<5<6"@Script data escaped'),
    'escaped dashes': ("SCRIPT_DATA_ESCAPED_DASH_DASH", "script", "---<a>-->b", '"---<a>-->b"@Script data'),
    "escape start that isn't": ("SCRIPT_DATA_ESCAPE_START", "script", "-a--b", '"-a--b"@Script data'),
    'double escaped': ("SCRIPT_DATA_DOUBLE_ESCAPED", "script", "a<b</script >c</script>d", '"a<b</script >c"</script>"d"@Data'),
    'double escaped, ends by dashes': ("SCRIPT_DATA_DOUBLE_ESCAPED", "script", "a-->b</script>c", '"a-->b"</script>"c"@Data'),
    'double escape start': ("SCRIPT_DATA_DOUBLE_ESCAPE_START", "script", "script/x", '"script/x"@Script data double escaped'),
    'double escape end': ("SCRIPT_DATA_DOUBLE_ESCAPE_END", "script", "scripts>y", '"scripts>y"@Script data double escaped'),
    'rcdata': ("RCDATA", "title", "Fish &amp; <chips></titles></title>!", '"Fish & <chips></titles>"</title>"!"@Data'),
    'rcdata, nul and other ends': ("RCDATA", "textarea", "\0</title></ textarea></textarea id=x>y&lt", '"\\0</title></ textarea>"</textarea id="x">"y<"@Data'),
    'rcdata at the end': ("RCDATA", "textarea", "a</textarea", '"a</textarea"@RCDATA'),
    'rawtext': ("RAWTEXT", "style", "p>q{a:&amp;}</styles></STYLE/>r", '"p>q{a:&amp;}</styles>"</style>"r"@Data'),
    'rawtext, nul and less-than': ("RAWTEXT", "xmp", "<\0<</xm", '"<\\0<</xm"@RAWTEXT'),
    'plaintext': ("PLAINTEXT", "plaintext", "</plaintext>&lt;\0", '"</plaintext>&lt;\\0"@PLAINTEXT'),
    'cdata': ("CDATA_SECTION", None, "]]]x]]>y", '"]]]xy"@Data'),
    'no start tag known': ("RCDATA", None, "a</title>b", '"a</title>b"@RCDATA'),
    'inside a tag': ("BEFORE_ATTRIBUTE_NAME", None, "x", "@After attribute name"),
}
#: name -> context, html, expected nodes: depth.kind or tag, attributes, text.
TREES = {
    'text elements hold text': (None, "<title>a<b>c</title><textarea>&amp;<i></textarea><style>d<e></style><xmp>&lt;</xmp>f", '1<title> 2"a<b>c" 1<textarea> 2"&<i>" 1<style> 2"d<e>" 1<xmp> 2"&lt;" 1"f"'),
    'a script and what follows': (None, "<section><script>if (x < y) { '</div>' }</script><p>z</section>w", "1<section> 2<script> 3\"if (x < y) { '</div>' }\" 2<p> 3\"z\" 1\"w\""),
    'void elements hold nothing': (None, "<p>a<br>b<img alt='c'><hr/>d</br>e</p>", '1<p> 2"a" 2<br> 2"b" 2<img alt="c"> 2<hr> 2"de"'),
    'self-closing others too': (None, "<ul><li/><li>x<b/>y</ul>z", '1<ul> 2<li> 2<li> 3"x" 3<b> 3"y" 1"z"'),
    'end tags close what is open': (None, "<a><b><c>x</a>y</b>z", '1<a> 2<b> 3<c> 4"x" 1"yz"'),
    'end tags for nothing': (None, "</p>x<i>y</u>z</i></i>", '1"x" 1<i> 2"yz"'),
    'texts join, others part them': (None, "<p>a&lt;b<!--c-->d</p>e&#33;<![CDATA[f]]>g", '1<p> 2"a<b" 2{c} 2"d" 1"e!fg"'),
    'left open': (None, "<table><tr><td>1<td>2", '1<table> 2<tr> 3<td> 4"1" 4<td> 5"2"'),
    'comments and doctypes': (None, "<!DOCTYPE x><!--a--><div><!--b--></div><?c?>", "1{a} 1<div> 2{b} 1{?c?}"),
    'plaintext to the end': (None, "<div><plaintext>a</plaintext></div>", '1<div> 2<plaintext> 3"a</plaintext></div>"'),
    'fragment in a title': ("title", "<em>x</em></title><em>y", '1"<em>x</em>" 1<em> 2"y"'),
    'fragment in a style': ("style", "a</b>&amp;</style>c&amp;", '1"a</b>&amp;c&"'),
    'fragment in a script': ("script", "<!--<script>a</script>-->b</script>c", '1"<!--<script>a</script>-->bc"'),
    'fragment in plaintext': ("plaintext", "<p>x</p></plaintext>", '1"<p>x</p></plaintext>"'),
    'fragment in a list': ("ul", "<li>x<li>y&amp;", '1<li> 2"x" 2<li> 3"y&"'),
}
SANITIZED = {
    'scripts in and around': ("<main>a<script>b<c></script>d<p><SCRIPT src=e></SCRIPT>f</p></main><script>g", "<main>ad<p>f</p></main>"),
    'handlers by any case': ("<svg OnLoad='a()'><g onclick=b id=c ONmouseover=\"d\"></g></svg>", '<svg><g id="c"></g></svg>'),
    'schemes with tricks': ("<a href='JaVaScRiPt:a'>1</a><a href='\t\n javascript:b'>2</a><a href='&#106;avascript&colon;c'>3</a><img src=javascript:d alt=e>", '<a>1</a><a>2</a><a href="javascript&amp;colon;c">3</a><img alt="e">'),
    'schemes that stay': ("<a href='/javascript:x'>1</a><a href='data:text/html,y'>2</a><a title='javascript:z'>3</a>", '<a href="/javascript:x">1</a><a href="data:text/html,y">2</a><a title="javascript:z">3</a>'),
    'text that looks like markup': ("<p>&lt;script&gt;a&lt;/script&gt; &amp;lt; b</p>", "<p>&lt;script>a&lt;/script> &amp;lt; b</p>"),
    'text elements': ("<textarea><script>a</script></textarea><title><img onerror=b></title>", "<textarea>&lt;script>a&lt;/script></textarea><title>&lt;img onerror=b></title>"),
    'quotes in values': ("<p title='a\"b' lang=\"c&quot;d&amp;e\">f</p>", '<p title="a&quot;b" lang="c&quot;d&amp;e">f</p>'),
    'a script that hides in a comment': ("<!--<script>a</script>--><p>b</p><!--c--!><i onx=d>e</i>", "<!--<script>a</script>--><p>b</p><!--c--><i>e</i>"),
    'a script in a style and the other way': ("<style><script>a</script></style><script><style>b</script>c</style>d", "<style>&lt;script>a&lt;/script></style>cd"),
    'broken tags': ("<p <script>a</p><a href=javascript:b onclick=c<d>e<b", '<p <script="">a</p><a>e</a>'),
    'void and self-closing': ("<br/><input onfocus=a value=b><div/>c", '<br><input value="b"><div></div>c'),
    'nested drops': ("<div><script>a</div>b</script><div>c<script>d</script></div></div>e", "<div><div>c</div></div>e"),
}
#: name -> html, its errors in order, driven by a tree builder: state: code.
ERRORS = {
    'references': ("&#0;&#x110000;&#xDFFF;&#x80;&#;&#x;&amp&#65 &lt=", "Character reference in data: null-character-reference; Character reference in data: character-reference-outside-unicode-range; Character reference in data: surrogate-character-reference; Character reference in data: control-character-reference; Character reference in data: absence-of-digits-in-numeric-character-reference; Character reference in data: absence-of-digits-in-numeric-character-reference; Character reference in data: missing-semicolon-after-character-reference; Character reference in data: missing-semicolon-after-character-reference; Character reference in data: missing-semicolon-after-character-reference"),
    'characters': ("a\0<b\0 c\0=d\0 e='\0'>", "Data: unexpected-null-character; Tag name: unexpected-null-character; Attribute name: unexpected-null-character; Attribute value (unquoted): unexpected-null-character; Attribute value (single-quoted): unexpected-null-character"),
    'attributes': ("<p a=1 a=2 b='3'c=\"4\"d = e'f ='g' h=><q/ r></s t=u/>", "Attribute name: duplicate-attribute; After attribute value (quoted): missing-whitespace-between-attributes; After attribute value (quoted): missing-whitespace-between-attributes; Before attribute name: unexpected-equals-sign-before-attribute-name; Attribute name: unexpected-character-in-attribute-name; Attribute name: unexpected-character-in-attribute-name; Before attribute value: missing-attribute-value; Self-closing start tag: unexpected-solidus-in-tag"),
    'tag starts': ("<1></></2><?x><!y>", "Tag open: invalid-first-character-of-tag-name; End tag open: missing-end-tag-name; End tag open: invalid-first-character-of-tag-name; Tag open: unexpected-question-mark-instead-of-tag-name; Markup declaration open: incorrectly-opened-comment"),
    'comments': ("<!--><!---><!--a--!><!-- <!-- --><!--b", "Comment start: abrupt-closing-of-empty-comment; Comment start dash: abrupt-closing-of-empty-comment; Comment end bang: incorrectly-closed-comment; Comment: eof-in-comment"),
    'doctypes, names': ("<!DOCTYPEa><!DOCTYPE><!DOCTYPE b c>", "DOCTYPE: missing-whitespace-before-doctype-name; DOCTYPE: missing-whitespace-before-doctype-name; Before DOCTYPE name: missing-doctype-name; After DOCTYPE name: invalid-character-sequence-after-doctype-name"),
    'doctypes, public': ("<!DOCTYPE a PUBLIC><!DOCTYPE b PUBLIC x><!DOCTYPE c PUBLIC\"d\"\"e\"><!DOCTYPE f PUBLIC'g>", "After DOCTYPE public keyword: missing-doctype-public-identifier; Before DOCTYPE public identifier: missing-quote-before-doctype-public-identifier; After DOCTYPE public keyword: missing-whitespace-after-doctype-public-keyword; After DOCTYPE public identifier: missing-whitespace-between-doctype-public-and-system-identifiers; After DOCTYPE public keyword: missing-whitespace-after-doctype-public-keyword; DOCTYPE public identifier (single-quoted): abrupt-doctype-public-identifier"),
    'doctypes, system': ("<!DOCTYPE a SYSTEM><!DOCTYPE b SYSTEM x><!DOCTYPE c SYSTEM'd'e><!DOCTYPE f SYSTEM\"g>", "After DOCTYPE system keyword: missing-doctype-system-identifier; Before DOCTYPE system identifier: missing-quote-before-doctype-system-identifier; After DOCTYPE system keyword: missing-whitespace-after-doctype-system-keyword; After DOCTYPE system identifier: unexpected-character-after-doctype-system-identifier; After DOCTYPE system keyword: missing-whitespace-after-doctype-system-keyword; DOCTYPE system identifier (double-quoted): abrupt-doctype-system-identifier"),
    'doctype at the end': ("<!DOCTYPE a PUBLIC 'b", "DOCTYPE public identifier (single-quoted): eof-in-doctype"),
    'cdata at the end': ("<![CDATA[x", "CDATA section: eof-in-cdata"),
    'tag at the end': ("<div a='b", "Attribute value (single-quoted): eof-in-tag"),
    'tag name at the end': ("</", "End tag open: eof-before-tag-name"),
    'script comment at the end': ("<script><!--x", "Script data escaped: eof-in-script-html-comment-like-text"),
    'tag in a script comment at the end': ("<script><!--<script>y", "Script data double escaped: eof-in-script-html-comment-like-text"),
    'none': ("<!DOCTYPE html><p class=a>b&lt;c</p><!-- d -->", ""),
}
#: name -> first state, last start tag, html, the runs of its trace: state, steps, first position. All 68 states are in one of them.
TRACES = {
    'no space after a quote': (None, None, "<u a='1'b=\"2\"c/>", "Data 1 0; Tag open 1 1; Tag name 2 1; Before attribute name 1 3; Attribute name 2 3; Before attribute value 1 5; Attribute value (single-quoted) 2 6; After attribute value (quoted) 1 8; Before attribute name 1 8; Attribute name 2 8; Before attribute value 1 10; Attribute value (double-quoted) 2 11; After attribute value (quoted) 1 13; Before attribute name 1 13; Attribute name 2 13; After attribute name 1 14; Self-closing start tag 1 15; Data 1 16"),
    'script nul and end': ("SCRIPT_DATA", "script", "\0<!--\0-\0--\0<script>\0-\0--\0", "Script data 2 0; Script data less-than sign 1 2; Script data escape start 1 3; Script data escape start dash 1 4; Script data escaped dash dash 1 5; Script data escaped 1 6; Script data escaped dash 1 7; Script data escaped 1 8; Script data escaped dash 1 9; Script data escaped dash dash 1 10; Script data escaped 1 11; Script data escaped less-than sign 1 12; Script data double escape start 7 12; Script data double escaped 2 19; Script data double escaped dash 1 21; Script data double escaped 1 22; Script data double escaped dash 1 23; Script data double escaped dash dash 1 24; Script data double escaped 1 25"),
    'cut: system identifier': (None, None, "<!DOCTYPE par PUBLIC \"q\" 'r", "Data 1 0; Tag open 1 1; Markup declaration open 1 2; DOCTYPE 1 9; Before DOCTYPE name 1 10; DOCTYPE name 3 11; After DOCTYPE name 1 14; After DOCTYPE public keyword 1 20; Before DOCTYPE public identifier 1 21; DOCTYPE public identifier (double-quoted) 2 22; After DOCTYPE public identifier 1 24; Between DOCTYPE public and system identifiers 1 25; DOCTYPE system identifier (single-quoted) 2 26"),
    'rawtext, nul and less-than': ("RAWTEXT", "xmp", "<\0<</xm", "RAWTEXT 1 0; RAWTEXT less-than sign 1 1; RAWTEXT 2 1; RAWTEXT less-than sign 1 3; RAWTEXT 1 3; RAWTEXT less-than sign 1 4; RAWTEXT end tag open 1 5; RAWTEXT end tag name 2 6; RAWTEXT 1 8"),
    'open after a bang': (None, None, "x<!--never--!", "Data 2 0; Tag open 1 2; Markup declaration open 1 3; Comment start 1 5; Comment 6 5; Comment end dash 1 11; Comment end 1 12; Comment end bang 1 13"),
    'no start tag known': ("RCDATA", None, "a</title>b", "RCDATA 2 0; RCDATA less-than sign 1 2; RCDATA end tag open 1 3; RCDATA end tag name 5 4; RCDATA 3 8"),
    'tag name at the end': (None, None, "</", "Data 1 0; Tag open 1 1; End tag open 1 2; Data 1 3"),
    'cut: after system': (None, None, '<!DOCTYPE par SYSTEM "r"', "Data 1 0; Tag open 1 1; Markup declaration open 1 2; DOCTYPE 1 9; Before DOCTYPE name 1 10; DOCTYPE name 3 11; After DOCTYPE name 1 14; After DOCTYPE system keyword 1 20; Before DOCTYPE system identifier 1 21; DOCTYPE system identifier (double-quoted) 2 22; After DOCTYPE system identifier 1 24"),
    'double escaped': ("SCRIPT_DATA_DOUBLE_ESCAPED", "script", "a<b</script >c</script>d", "Script data double escaped 2 0; Script data double escaped less-than sign 1 2; Script data double escaped 2 2; Script data double escaped less-than sign 1 4; Script data double escape end 7 5; Script data escaped 3 12; Script data escaped less-than sign 1 15; Script data escaped end tag open 1 16; Script data escaped end tag name 6 17; Data 2 23"),
    'double escaped, ends by dashes': ("SCRIPT_DATA_DOUBLE_ESCAPED", "script", "a-->b</script>c", "Script data double escaped 2 0; Script data double escaped dash 1 2; Script data double escaped dash dash 1 3; Script data 2 4; Script data less-than sign 1 6; Script data end tag open 1 7; Script data end tag name 6 8; Data 2 14"),
    'open at the start, one dash': (None, None, "x<!---", "Data 2 0; Tag open 1 2; Markup declaration open 1 3; Comment start 1 5; Comment start dash 1 6"),
    'cut off at the end': (None, None, "tea &a", "Data 5 0; Character reference in data 1 5; Data 2 5"),
    'nul in a bogus one': (None, None, "<!\0a\0>b", "Data 1 0; Tag open 1 1; Markup declaration open 1 2; Bogus comment 4 2; Data 2 6"),
    'cdata': ("CDATA_SECTION", None, "]]]x]]>y", "CDATA section 5 0; Data 2 7"),
    'lone ampersands in values': (None, None, "<a b='&' c=\"& &\" d=& e=&>", "Data 1 0; Tag open 1 1; Tag name 2 1; Before attribute name 1 3; Attribute name 2 3; Before attribute value 1 5; Attribute value (single-quoted) 1 6; Character reference in attribute value 1 7; Attribute value (single-quoted) 1 7; After attribute value (quoted) 1 8; Before attribute name 1 9; Attribute name 2 9; Before attribute value 1 11; Attribute value (double-quoted) 1 12; Character reference in attribute value 1 13; Attribute value (double-quoted) 2 13; Character reference in attribute value 1 15; Attribute value (double-quoted) 1 15; After attribute value (quoted) 1 16; Before attribute name 1 17; Attribute name 2 17; Before attribute value 1 19; Attribute value (unquoted) 1 19; Character reference in attribute value 1 20; Attribute value (unquoted) 1 20; Before attribute name 1 21; Attribute name 2 21; Before attribute value 1 23; Attribute value (unquoted) 1 23; Character reference in attribute value 1 24; Attribute value (unquoted) 1 24; Data 1 25"),
    'plaintext': ("PLAINTEXT", "plaintext", "</plaintext>&lt;\0", "PLAINTEXT 18 0"),
    'cut: junk': (None, None, "<!DOCTYPE par junk", "Data 1 0; Tag open 1 1; Markup declaration open 1 2; DOCTYPE 1 9; Before DOCTYPE name 1 10; DOCTYPE name 3 11; After DOCTYPE name 1 14; Bogus DOCTYPE 5 14"),
    'doctype at the end': (None, None, "<!DOCTYPE a PUBLIC 'b", "Data 1 0; Tag open 1 1; Markup declaration open 1 2; DOCTYPE 1 9; Before DOCTYPE name 1 10; DOCTYPE name 1 11; After DOCTYPE name 1 12; After DOCTYPE public keyword 1 18; Before DOCTYPE public identifier 1 19; DOCTYPE public identifier (single-quoted) 2 20"),
    'rcdata': ("RCDATA", "title", "Fish &amp; <chips></titles></title>!", "RCDATA 6 0; Character reference in RCDATA 1 6; RCDATA 2 10; RCDATA less-than sign 1 12; RCDATA 7 12; RCDATA less-than sign 1 19; RCDATA end tag open 1 20; RCDATA end tag name 6 21; RCDATA 2 26; RCDATA less-than sign 1 28; RCDATA end tag open 1 29; RCDATA end tag name 5 30; Data 2 35"),
}
NEWLINES = {
    "of all three kinds": ("north\r\neast\rsouth\nwest", "north\neast\nsouth\nwest"),
    "next to each other": ("\r\r\n\n\r", "\n\n\n\n"),
    "at both ends": ("\r\ninside\r", "\ninside\n"),
    "none": ("a b\tc", "a b\tc"),
}
#: name -> html, the labels of its tokens.
SHAPES = {
    'a small page': ("<!DOCTYPE html><html lang=en><body><p>one<br/>two</p><!--three--></body></html>", "DOCTYPE <html> <body> <p> <br/> </p> <!--three--> </body> </html> EOF"),
    'scripts and styles': ("<style>a<b</style><script>c<d</script><IMG src=e>", "<style> </style> <script> </script> <img> EOF"),
    'text alone': ("six &amp; seven", "EOF"),
    'nothing': ("", "EOF"),
    'odd ends': ("<a/></b x=1></a /><!x>", "<a/> </b> </a> <!--x--> EOF"),
}
#: name -> html, runs of tokens of one kind: kind, first, last, tokens.
RUNS = {
    'a small page': ("<!DOCTYPE html><html lang=en><body><p>one<br/>two</p><!--three--></body></html>", "DOCTYPE 0 0 1; StartTag 1 3 3; Character 4 4 1; StartTag 5 5 1; Character 6 6 1; EndTag 7 7 1; Comment 8 8 1; EndTag 9 10 2; EOF 11 11 1"),
    'scripts and styles': ("<style>a<b</style><script>c<d</script><IMG src=e>", "StartTag 0 0 1; Character 1 1 1; StartTag 2 3 2; Character 4 4 1; StartTag 5 6 2; EOF 7 7 1"),
    'text alone': ("six &amp; seven", "Character 0 2 3; EOF 3 3 1"),
    'nothing': ("", "EOF 0 0 1"),
    'odd ends': ("<a/></b x=1></a /><!x>", "StartTag 0 0 1; EndTag 1 2 2; Comment 3 3 1; EOF 4 4 1"),
}
#: name -> html, its tokens for display.
PRETTY = {
    'a page': ("<!DOCTYPE book PUBLIC 'p' 's'><section id=a class='b \"c\"'>d\ne&lt;<hr/></section><!-- f -->", 'DOCTYPE book p s / StartTag <section id="a" class="b "c""> / Character "d\\ne" / Character "<" / StartTag <hr/> / EndTag </section> / Comment " f " / EOF'),
    'quirks': ("<!DOCTYPE>x<!DOCTYPE y SYSTEM>", 'DOCTYPE (quirks) / Character "x" / DOCTYPE y (quirks) / EOF'),
    'nothing': ("", "EOF"),
}
#: name -> html, how many nodes it has as a fragment of each element.
CONTEXTS = {
    'markup': ("<b>x</b><i>y</i>", "div 5; plaintext 2; script 2; style 2; textarea 2"),
    'text ends': ("a</textarea><u>b</style><s>c</script>d", "div 6; plaintext 2; script 2; style 4; textarea 6"),
    'references': ("&lt;b&gt;<!--c-->", "div 3; plaintext 2; script 2; style 2; textarea 2"),
}
#: name -> html, the deepest node and how many there are.
DEPTHS = {
    'flat': ("a<br>b", "1 4"),
    'nested': ("<ol><li><b>x</b></li><li>y</ol>z", "4 8"),
    'left open': ("<a><b><c><d>", "4 5"),
    'nothing': ("", "0 1"),
}


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _values(cases: dict[str, str]) -> str:
    """SQL rows of case_id and result."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join(f"({quote(k)}, {quote(v)})" for k, v in cases.items()) + ") t(case_id, result)"


def _attributes(attrs: Column) -> Column:
    return F.array_join(F.transform(attrs, lambda a: F.concat(F.lit(" "), a["name"], F.lit('="'), a["value"], F.lit('"'))), "")


def token_line(tokens: Column) -> Column:
    """The tokens of a document as a line; characters are one quoted text up to the next other token."""
    dash = lambda c: F.coalesce(c, F.lit("-"))
    piece = lambda t: (
        F.when(t["kind"] == "StartTag", F.concat(F.lit("<"), t["tag"], _attributes(t["attrs"]), F.when(t["self_closing"], F.lit("/>")).otherwise(F.lit(">"))))
        .when(t["kind"] == "EndTag", F.concat(F.lit("</"), t["tag"], _attributes(t["attrs"]), F.lit(">")))
        .when(t["kind"] == "Comment", F.concat(F.lit("{"), t["data"], F.lit("}")))
        .when(t["kind"] == "DOCTYPE", F.concat(F.lit("!"), F.concat_ws("|", dash(t["dt_name"]), dash(t["dt_public"]), dash(t["dt_system"]), t["force_quirks"].cast("string"))))
        .when(t["kind"] == "Character", F.concat(F.lit("\x01"), F.replace(t["data"], F.lit("\0"), F.lit("\\0")), F.lit("\x01")))
        .otherwise(F.lit(""))
    )
    line = F.array_join(F.transform(tokens, piece), "")
    return F.replace(F.replace(line, F.lit("\x01\x01"), F.lit("")), F.lit("\x01"), F.lit('"'))


def _lines(cases: dict[str, tuple[str, str]]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _frame(spark, [(k, h) for k, (h, _) in cases.items()], "doc_id string, html string")
        return lexed(docs).select(F.col("doc_id").alias("case_id"), token_line(F.col("x.tokens")).alias("result"))

    return query, _values({k: e for k, (_, e) in cases.items()})


def _forced_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _frame(spark, [(k, h, s, t) for k, (s, t, h, _) in FORCED.items()], "doc_id string, html string, init_state string, last_start_tag string")
    out = lexed(docs, init_state=F.col("init_state"), last_start_tag=F.col("last_start_tag"))
    return out.select(F.col("doc_id").alias("case_id"), F.concat(token_line(F.col("x.tokens")), F.lit("@"), "x.end_state").alias("result"))


def _tree_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _frame(spark, [(k, h, c) for k, (c, h, _) in TREES.items()], "doc_id string, html string, context string")
    nodes = build_tree(docs, context=F.col("context")).where("kind <> 'document'")
    shown = F.when(F.col("kind") == "element", F.concat(F.lit("<"), "tag", _attributes(F.col("attrs")), F.lit(">"))).when(F.col("kind") == "comment", F.concat(F.lit("{"), "data", F.lit("}"))).otherwise(F.concat(F.lit('"'), "data", F.lit('"')))
    lines = nodes.withColumn("s", F.concat(F.col("depth").cast("string"), shown, F.lit(" ")))
    return ordered_text(lines, "doc_id", order="pre", data="s", name="result").select(F.col("doc_id").alias("case_id"), F.rtrim("result").alias("result"))


def _sanitize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _frame(spark, [(k, h) for k, (h, _) in SANITIZED.items()], "doc_id string, html string")
    return sanitize(docs).select(F.col("doc_id").alias("case_id"), F.col("html").alias("result"))


def _newline_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _frame(spark, [(k, h) for k, (h, _) in NEWLINES.items()], "case_id string, html string")
    return docs.select("case_id", preprocess(F.col("html")).alias("result"))


def _joined(rows: DataFrame, order: str, line: Column, separator: str = "; ") -> DataFrame:
    """case_id, result: the lines of each case in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("s"))))
    return rows.groupBy(F.col("doc_id").alias("case_id")).agg(F.array_join(F.transform(parts, lambda p: p["s"]), separator).alias("result"))


def _html(spark: SparkSession, cases: dict[str, tuple[str, str]]) -> DataFrame:
    return _frame(spark, [(k, h) for k, (h, _) in cases.items()], "doc_id string, html string")


def _error_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = lexed(_html(spark, ERRORS), want=("errors",), driven=True)
    return errors.select(F.col("doc_id").alias("case_id"), F.array_join(F.transform("x.errors", lambda e: F.concat(e["state"], F.lit(": "), e["code"])), "; ").alias("result"))


def _trace_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _frame(spark, [(k, h, s, t) for k, (s, t, h, _) in TRACES.items()], "doc_id string, html string, init_state string, last_start_tag string")
    return _joined(trace_runs(docs, init_state=F.col("init_state"), last_start_tag=F.col("last_start_tag")), "run", F.concat_ws(" ", "state", "n", "pos"))


def _shape_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(shape(tokenize(_html(spark, SHAPES), driven=True)), "tok", F.col("label"), " ")


def _run_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(coalesce_runs(tokenize(_html(spark, RUNS)), order="tok", value="kind"), "run", F.concat_ws(" ", "kind", "first", "last", "n"))


def _pretty_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(pretty(tokenize(_html(spark, PRETTY), driven=True)), "tok", F.col("line"), " / ")


def _context_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parse_in_contexts(_html(spark, CONTEXTS), ("div", "textarea", "style", "script", "plaintext"))
    return _joined(found, "context", F.concat_ws(" ", "context", F.size("nodes").cast("string")))


def _depth_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    deepest = build_tree(_html(spark, DEPTHS)).groupBy(F.col("doc_id").alias("case_id")).agg(F.max("depth").alias("d"), F.count("*").alias("n"))
    return deepest.select("case_id", F.concat_ws(" ", "d", "n").alias("result"))


QUERIES = {"fixture_text": _lines(TEXT), "fixture_tags": _lines(TAGS), "fixture_declarations": _lines(DECLARATIONS)}
QUERIES |= {
    "fixture_newlines": (_newline_query, _values({k: e for k, (_, e) in NEWLINES.items()})),
    "fixture_errors": (_error_query, _values({k: e for k, (_, e) in ERRORS.items()})),
    "fixture_traces": (_trace_query, _values({k: e for k, (*_, e) in TRACES.items()})),
    "fixture_shapes": (_shape_query, _values({k: e for k, (_, e) in SHAPES.items()})),
    "fixture_runs": (_run_query, _values({k: e for k, (_, e) in RUNS.items()})),
    "fixture_pretty": (_pretty_query, _values({k: e for k, (_, e) in PRETTY.items()})),
    "fixture_contexts": (_context_query, _values({k: e for k, (_, e) in CONTEXTS.items()})),
    "fixture_depths": (_depth_query, _values({k: e for k, (_, e) in DEPTHS.items()})),
    "fixture_forced_states": (_forced_query, _values({k: e for k, (*_, e) in FORCED.items()})),
    "fixture_trees": (_tree_query, _values({k: e for k, (*_, e) in TREES.items()})),
    "fixture_sanitized": (_sanitize_query, _values({k: e for k, (_, e) in SANITIZED.items()})),
}
