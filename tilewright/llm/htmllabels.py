"""Labelled pages: what lies between [[ and ]] is main text. Written for training; no page is taken from anywhere."""

#: Sentences that fill the pages.
_A = "The river rose quickly after two days of rain and the lower fields were under water by noon. People moved their animals to the hill behind the church and waited there."
_B = "Researchers counted the birds on the island again this spring and found more nests than in any year since the survey began, which they put down to the quieter harbour."
_C = "To bake the bread you need flour, water, salt and time. Mix them in the evening, leave the dough overnight, shape it in the morning and let it rise for another hour."

PAGES = (
    f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>River</title><style>p{{margin:0}}</style><script>var a="</p>";go(1);</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">About us</a></li></ul></nav><!-- x --><div class="ad">Buy two and pay for one, this week only.</div><article>[[<h1>River rises</h1><p>{_A}</p><p>{_B}<br>{_C}</p>]]</article><footer>&copy; example &middot; All rights reserved by the owners.</footer></body></html>',
    f'<html><body><header><h1>The Daily Page</h1><form action="/s"><input name="q"><button>Search</button><label>Search the site</label></form></header><main>[[<h2>Birds</h2><p>{_B}</p><ul><li>{_A}</li><li>{_C}</li></ul>]]</main><aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Ten tips for spring</a></li><li><a href="/2">Weather for the weekend</a></li></ul></aside><footer><p>Contact, imprint, privacy policy and terms of use</p></footer></body></html>',
    f'<html><body><div id="header"><div class="logo">Kitchen</div><div class="menu"><a href="/">Start</a> | <a href="/r">Recipes</a> | <a href="/k">Contact</a></div></div><div class="cookie-notice">We use cookies to improve your visit. <button>Accept all</button></div><div class="content">[[<h1>Bread</h1><p>{_C}</p><p>{_A}</p><blockquote>{_B}</blockquote>]]</div><div class="comments"><h3>Comments</h3><div class="comment"><p>Great recipe, I tried it twice and my family loved it very much!</p></div><div class="comment"><p>Too salty for me, but the crust was good in the end.</p></div></div><div id="footer">Copyright by the kitchen team, since the year 2001</div></body></html>',
    f'<html><body><div class="topbar"><span>Subscribe to our newsletter</span></div><div class="nav"><ul><li><a href="#">World</a></li><li><a href="#">Sport</a></li></ul></div><div class="post">[[<h1>Island</h1><p>{_B}</p>]]<div class="advertisement">Cheap flights to all islands, book before Friday and save a lot.</div>[[<p>{_A}</p><table><tr><td>Nests</td><td>214</td></tr></table>]]<div class="share">Share this on every network you know</div></div><div class="sidebar"><div class="widget">Recent posts and popular tags are shown here for you</div></div><div class="footer">Made with care</div></body></html>',
    f'<html><body><div class="banner">Sign up now and get your first month free of charge.</div><article><header>[[<h1>Bread at home</h1>]]</header>[[<p>{_C}</p><p>{_B}</p>]]<aside>Related: how to keep flour fresh, and other stories from the kitchen</aside>[[<p>{_A}</p>]]</article><section class="comments"><p>First! I disagree with all of this, and so does everyone in my street.</p></section><script>track();</script><noscript>Please turn on scripts to see this page in full.</noscript></body></html>',
    f'<html><body><table class="layout"><tr><td class="menu"><a href="/1">One</a><a href="/2">Two</a></td><td class="main-content">[[<p>{_A}</p><p>{_B}</p><pre>{_C}</pre>]]</td></tr></table><div class="legal">Terms and conditions apply to every use of the site.</div></body></html>',
    f'<html><body><div id="cookie-banner" role="dialog">This site uses cookies and similar tools.</div><div role="navigation"><a href="/x">Index</a><a href="/y">Archive</a></div><div role="main">[[<h1>Water</h1><div>{_A}</div><div>{_C}</div>]]</div><div role="complementary"><p>You may also like the stories that others read today.</p></div><div role="contentinfo">Imprint and privacy</div></body></html>',
    f'<html><body><p class="notice">The site is down for repairs on Sunday morning from two to four.</p><div class="entry-content">[[<p>{_B}</p><p><b>{_C}<br><p>{_A}</p>]]</div><form class="signup"><p>Enter your address to get our letter each week.</p><select><option>Daily</option><option>Weekly</option></select><textarea>Your message to us</textarea></form><nav class="pagination"><a href="?p=1">Previous page</a><a href="?p=3">Next page</a></nav></body></html>',
    f'<html><body><nav>[Menu] <a href="/">Home</a></nav><article>[[<h1>Short note</h1><p>{_A[:92]}</p>]]</article><div id="disqus_thread"><p>Someone wrote here that the note is far too short to be of use.</p></div><footer>Contact the editors by post or telephone at any time.</footer></body></html>',
)
