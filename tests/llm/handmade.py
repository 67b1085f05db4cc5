"""Pages written by hand, each with the text that a reader would call its article."""

A = "The council voted on Tuesday to close the old bridge for the whole of next summer."
B = "Engineers found cracks in two of the four piers, and repairs will take at least five months, the report says."
C = "Drivers will be sent over the northern bypass, which opened only last year."

PAGES = [
    # a news site with landmarks
    (f'<!doctype html><html lang=en><head><meta charset=utf-8><title>Bridge | Daily</title><link rel=stylesheet href=a.css></head><body><header class=masthead><a href=/>Daily</a><nav aria-label=Main><ul><li><a href=/n>News</a><li><a href=/s>Sport</a><li><a href=/w>Weather</a></ul></nav></header><main><article><h1>Bridge to close</h1><p class=byline>By A. Writer</p><p>{A}</p><figure><img src=b.jpg alt="bridge"></figure><p>{B}</p><aside class=related><h3>Related</h3><ul><li><a href=/1>Roads get wider</a></li><li><a href=/2>Bus fares rise</a></li></ul></aside><p>{C}</p></article></main><footer><p>&copy; 2024 Daily. <a href=/privacy>Privacy</a></p></footer></body></html>', f"Bridge to close By A. Writer {A} {B} {C}"),
    # a blog without landmarks
    (f'<html><body><div id="wrapper"><div id="header"><h2><a href="/">My notes</a></h2></div><div id="menu"><a href="/a">About</a> <a href="/c">Contact</a></div><div id="content"><div class="post"><h1>On bridges</h1><p>{A}</p><p>{B}</p><blockquote><p>{C}</p></blockquote></div><div id="comments"><h3>2 comments</h3><div class="comment"><b>Ann</b><p>I never liked that bridge anyway, to be honest.</p></div><div class="comment"><b>Bob</b><p>Nice.</p></div></div></div><div id="sidebar"><h3>Archive</h3><ul><li><a href="/1">May</a></li><li><a href="/2">June</a></li></ul></div><div id="footer">Powered by nothing</div></div></body></html>', f"On bridges {A} {B} {C}"),
    # inline markup, entities, an image inside a word, line breaks
    (f"<body><nav><a href=/>Home</a><a href=/b>Blog</a></nav><article><h1>Salt &amp; pepper</h1><p>Caf&eacute; <em>owners</em> know: salt<img src=x.png>y food s<b>ell</b>s &mdash; always.<br>{A}</p><p>{B}</p></article></body>", f"Salt & pepper Café owners know: salty food sells — always. {A} {B}"),
    # scripts, styles and comments in the middle
    (f'<body><div class="article-body"><h1>Title</h1><script>if (a < b) document.write("<p>no</p>");</script><p>{A}</p><style>.x{{color:red}}</style><!-- <p>hidden</p> --><p>{B}</p><noscript><p>Enable scripts</p></noscript></div><div class="newsletter"><form action=/s><label>E-mail</label><input name=e><button>Subscribe</button></form></div></body>', f"Title {A} {B}"),
    # headings, lists and a table inside the article
    (f"<body><header><h1>Docs</h1></header><main><h1>Install</h1><p>{A}</p><h2>Steps</h2><ol><li>Download the archive and unpack it.</li><li>Run the installer, then restart the machine.</li></ol><table><tr><th>Flag</th><th>Meaning</th></tr><tr><td>-v</td><td>print more</td></tr></table><p>{C}</p></main><footer>Docs team</footer></body>", f"Install {A} Steps Download the archive and unpack it. Run the installer, then restart the machine. Flag Meaning -v print more {C}"),
    # cookie notice and adverts around
    (f'<body><div class="cookie-notice"><p>We use cookies to make this site better. By staying here you agree to them.</p><button>OK</button></div><div class="ad">Buy shoes now, half price!</div><section class="entry-content"><h1>Bridge</h1><p>{A}</p><div class="advertisement"><a href=/ad>Sponsored: the best shoes</a></div><p>{B}</p></section><div class="share-buttons"><a href=#>Share</a><a href=#>Post</a></div></body>', f"Bridge {A} {B}"),
    # unclosed tags
    (f"<html><body><ul class=nav><li><a href=/>Home</a><li><a href=/x>X</a></ul><div class=content><h1>Open tags<p>{A}<p>{B}<ul><li>First point of the list.<li>Second point of the list.</ul></div><div class=footer>The end of the site", f"Open tags {A} {B} First point of the list. Second point of the list."),
    # breadcrumb and pager
    (f'<body><nav class="breadcrumb"><a href=/>Home</a> &gt; <a href=/n>News</a></nav><article class="post"><header><h1>Bridge</h1></header><p>{A} <a href="/report">{B}</a></p><p>{C}</p></article><div class="pagination"><a href=/1>1</a> <a href=/2>2</a> <a href=/3>Next</a></div></body>', f"Bridge {A} {B} {C}"),
    # no class names at all
    (f"<body><div><a href=/>Home</a> | <a href=/n>News</a> | <a href=/c>Contact</a></div><div><h1>Bridge to close</h1><p>{A}</p><p>{B}</p><p>{C}</p></div><div><a href=/t>Terms</a> | <a href=/p>Privacy</a></div></body>", f"Bridge to close {A} {B} {C}"),
    # an icon in front and code in the text
    (f'<body><header><svg viewBox="0 0 1 1"><path d="M0 0"/></svg><a href=/>Site</a></header><main><article><h1>Sorting</h1><p>{A}</p><pre>for x in sorted(y):\n    print(x)</pre><p>{B}</p></article></main></body>', f"Sorting {A} for x in sorted(y): print(x) {B}"),
    # an old layout of tables
    (f'<body><table><tr><td class="sidebar"><a href=/>Home</a><br><a href=/l>Links</a></td><td class="main"><h1>Bridge</h1><p>{A}</p><p>{B}</p></td></tr></table></body>', f"Bridge {A} {B}"),
    # nothing but navigation
    ('<body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>Blog</a></li></ul></nav><footer>&copy; me</footer></body>', ""),
    # text in another script
    ("<body><nav><a href=/>首页</a><a href=/x>新闻</a></nav><article><h1>大桥将关闭</h1><p>市议会周二投票决定，明年整个夏天关闭这座老桥。</p><p>工程师在四个桥墩中的两个发现了裂缝，维修至少需要五个月。</p></article><footer>版权所有</footer></body>", "大桥将关闭 市议会周二投票决定，明年整个夏天关闭这座老桥。 工程师在四个桥墩中的两个发现了裂缝，维修至少需要五个月。"),
    # a forum-like page whose article is followed by many replies
    (f'<body><div class="topbar"><a href=/>Forum</a></div><main><div class="entry"><h1>Bridge closed?</h1><p>{A}</p><p>{C}</p></div><section class="responses"><h3>3 replies</h3><div class="reply"><span>user1</span><p>Is that the one near the mill, where the ferry used to be?</p></div><div class="reply"><span>user2</span><p>Yes. It was about time that somebody looked at it.</p></div></section></main></body>', f"Bridge closed? {A} {C}"),
]
