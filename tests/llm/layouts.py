"""Hand-written pages of many layouts and the blocks of their main text. None was made by the generator of training pages."""

A = "The harbour was quiet when the first boats came back, and nobody on the pier spoke above a whisper."
B = "Repairs took most of the winter. By spring the lock gates moved freely again, and the toll house had a new roof."
C = "Visitors may walk the towpath in either direction; the eastern half is paved."
CANALS = [
    ('<table><tr><td><a href=a.html>Start</a><br><a href=b.html>Tours</a><br><a href=c.html>Contact</a></td><td><h1>The canal</h1><p>It is old.</p><p>It is long.</p></td></tr></table>',["The canal","It is old.","It is long."]),
    (f'{A}<br><br>{B}<br><br><a href="index.html">Back</a>',[f"{A} {B}"]),
    (f'<table><tr><td>Menu <a href=x>a</a> <a href=y>b</a></td><td><p>{A}</p><p>{B}</p></td></tr></table>',[A,B]),
    (f'<h1>Canals</h1><p>{A}</p><p>{B}</p>',["Canals",A,B]),
    (f'<div><div><a href=/>Home</a> | <a href=/n>News</a></div><div><h2>Canals</h2><p>{A}</p><p>{C}</p></div><div>© 2020 The Canal Trust</div></div>',["Canals",A,C]),
    (f'<center><font size=2>{A}<p>{B}<p>{C}</font></center>',[A,B,C]),
    (f'<div class="wrapper"><div class="nav"><a href=1>One</a><a href=2>Two</a></div><div class="main-content"><p>{A}</p><ul><li>First lock</li><li>Second lock</li></ul></div></div>',[A,"First lock","Second lock"]),
    (f'<main><h1>Title</h1><p>{A}</p><div class="ad-slot">Buy cheap boats now</div><p>{B}</p></main><footer><p>All rights reserved</p></footer>',["Title",A,B]),
    (f'<header><h1>Site name</h1><form action=/s><input name=q><button>Go</button></form></header><article><h2>Story</h2><p>{A}</p><blockquote>{C}</blockquote></article>',["Story",A,C]),
    (f'<section class="post"><p>{A}</p></section><section class="comments"><h3>2 comments</h3><div class="comment"><p>Nice story, thanks!</p></div><div class="comment"><p>I was there as well.</p></div></section>',[A]),
    (f'<div id="cookie-banner">We use cookies. <button>OK</button></div><div id="story"><p>{A}</p><p>{B}</p></div>',[A,B]),
    (f'<nav><ul><li><a href=/>Home</a></li></ul></nav><p>{A}</p><p>{B}</p><footer>Copyright 2001</footer>',[A,B]),
    (f'<div id="header">Canal news</div><div id="left"><a href=1>Locks</a><br><a href=2>Boats</a></div><div id="text"><p>{A}<p>{B}</div>',[A,B]),
    (f'<article><header><h1>Winter works</h1></header><p>{A}</p><aside class="related"><a href=/z>Read also: boats</a></aside><p>{B}</p><footer>Filed under news</footer></article>',["Winter works",A,B]),
    (f'<pre>{A}\n{B}</pre>',[f"{A} {B}"]),
    (f'<div class="article-body">{A}<br><br>{B}</div><div class="share"><a href=f>Facebook</a> <a href=t>Twitter</a></div>',[f"{A} {B}"]),
    (f'<body bgcolor=white><p><a href="../">Up</a></p><h2>Locks</h2>{A}<p>{B}</p><hr><address>webmaster@example.org</address></body>',["Locks",A,B]),
    (f'<div class="page"><div class="sidebar"><h3>Popular</h3><p>Ten boats you will love</p><p>How to paint a bridge</p></div><div class="content"><h1>Locks</h1><p>{B}</p></div></div>',["Locks",B]),
    (f'<article><h1>Prices</h1><table><tr><th>Lock</th><th>Toll</th></tr><tr><td>East</td><td>5</td></tr></table><p>{C}</p></article>',["Prices","Lock","Toll","East","5",C]),
    (f'<main><p>{A}</p><form class="newsletter"><p>Get our letters every week</p><input type=email><button>Subscribe</button></form><p>{C}</p></main>',[A,C]),
    (f'<div><h1>Canals</h1><div>{A}</div><div>{B}</div></div><div><small>&copy; Canal Trust</small></div>',["Canals",A,B]),
    (f'<p>{A} See the <a href=/map>map of the locks</a> for more.</p>',[f"{A} See the map of the locks for more."]),
    (f'<div role="navigation"><a href=a>A</a> <a href=b>B</a></div><div role="main"><p>{A}</p></div><div role="contentinfo">Imprint</div>',[A]),
    (f'<dl><dt>Lock</dt><dd>{C}</dd><dt>Weir</dt><dd>{A}</dd></dl>',["Lock",C,"Weir",A]),
]

A = "Snow fell over the northern valleys on Tuesday night, closing two passes and delaying the morning trains."
B = "Ploughs were out before dawn, the road office said; most villages could be reached again by noon."
C = "More snow is forecast for Friday."
SNOW = [
    (f'<div class="container"><ul class="breadcrumbs"><li><a href=/>Home</a></li><li><a href=/w>Weather</a></li></ul><div class="entry-content"><h1>Snow</h1><p>{A}</p><p>{B}</p></div></div>',["Snow",A,B]),
    (f'<h2>Snow</h2>{A}<br><br>{B}<br><br>{C}',["Snow",f"{A} {B} {C}"]),
    (f'<div><p>{A}</p><p>{B}</p><p>{C}</p></div>',[A,B,C]),
    (f'<table width="100%"><tr><td colspan=2><a href=1>News</a> <a href=2>Sport</a> <a href=3>Weather</a></td></tr><tr><td><p>{A}</p><p>{C}</p></td></tr></table>',[A,C]),
    (f'<article class="post"><h1 class="title">Snow</h1><div class="text"><p>{A}</p></div><div class="tags"><a href=a>snow</a> <a href=b>roads</a></div></article>',["Snow",A]),
    (f'<main role="main"><section><h2>Roads</h2><p>{B}</p></section><section><h2>Outlook</h2><p>{C}</p></section></main><aside><h3>Most read</h3><ol><li><a href=x>Ten recipes for soup</a></li></ol></aside>',["Roads",B,"Outlook",C]),
    (f'<div id="page"><div id="masthead"><a href=/>The Valley Post</a></div><div id="main"><p>{A}<p>{B}</div><div id="rail"><p>Subscribe to our paper for one crown a week.</p></div></div>',[A,B]),
    (f'<header>The Valley Post</header><article><p>{A}</p><figure><img src=a.jpg><figcaption>A plough near the pass</figcaption></figure><p>{B}</p></article>',[A,"A plough near the pass",B]),
    (f'<article><p>{A}</p></article><div id="disqus_thread"><p>First!</p><p>Too much snow if you ask me.</p></div>',[A]),
    (f'<div class="alert">Our site will be down on Sunday.</div><article><h1>Snow</h1><p>{C}</p></article>',["Snow",C]),
    (f'<form id="login"><label>Name</label><input name=u><button>Log in</button></form><div class="story"><p>{A}</p><p>{B}</p></div><div class="footer">Imprint | Privacy</div>',[A,B]),
    (f'<p><font face=arial>{A}</font></p><p><font face=arial>{B}</font></p>',[A,B]),
    (f'<div class="post-body"><p>{A}</p><div class="advertisement"><p>Winter tyres, half price until Monday, only at our shop!</p></div><p>{B}</p></div>',[A,B]),
    (f'<nav><a href=/>Home</a></nav><main><h1>Snow &amp; ice</h1><p>{A}</p><ol><li>Check the tyres</li><li>Take a shovel</li></ol></main>',["Snow & ice",A,"Check the tyres","Take a shovel"]),
    (f'<div><a href="1.html">1</a> <a href="2.html">2</a> <a href="3.html">3</a></div><div>{A}<br>{B}</div>',[f"{A} {B}"]),
    (f'<section id="content"><article><h2>One</h2><p>{A}</p></article></section><section id="comments"><article class="comment"><p>Thank you for the report.</p></article></section>',["One",A]),
    (f'<h1>Snow</h1><p><i>{C}</i></p><p>{A}</p><hr><p><a href=index.html>Index</a></p>',["Snow",C,A]),
    (f'<div class="layout"><div class="col-1 menu"><p>Sections</p><a href=a>Local</a><a href=b>World</a></div><div class="col-2"><h1>Snow</h1><p>{A}</p><p>{B}</p></div></div>',["Snow",A,B]),
    (f'<article><h1>Snow</h1><p>{A}<ul><li>{C}<li>{B}</ul></article><div class="newsletter-box">Get our letter. <input><button>Go</button></div>',["Snow",A,C,B]),
    (f'<body><div><div><div><p>{B}</p></div></div></div><div>Copyright 2015 Valley Post</div></body>',[B]),
]
