"""Counts of marked pairs as a function of the JVM: the md5 of each pair in loops that its compiler turns into vector
instructions, where numpy passes some 510 arrays through a core's cache.

The source is compiled by Janino, which Spark brings for its own generated code, and sent to executors as a jar. Each of
the 61 steps of an md5 is a loop of its own over a few hundred pairs, as only short loops are vectorised."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import zipfile

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import SparkSession

from limen.functions.hashing import _PLACES, _SINES, _START, _TURNS, BLOCK

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

_MIX = ["((c[j] ^ d[j]) & b[j]) ^ d[j]", "((b[j] ^ c[j]) & d[j]) ^ c[j]", "b[j] ^ c[j] ^ d[j]", "c[j] ^ (b[j] | ~d[j])"]


def _steps(kind: int) -> str:
    """The steps of a quarter, with words of the tails and without. Eight loops in a method: it is too long to be put
    into its caller, where all of them at once would not be vectorised."""
    loop = lambda k, w: f"for (int j = 0; j < n; j++) {{ int t = a[j] + ({_MIX[kind]}){w} + s; a[j] = b[j] + ((t << {_TURNS[kind][k]}) | (t >>> {32 - _TURNS[kind][k]})); }}"
    cases = "".join(f"      case {2 * k}: {loop(k, '')} break;\n      case {2 * k + 1}: {loop(k, ' + w[j]')} break;\n" for k in range(4))
    return f"""
  static void quarter{kind}(int which, int[] a, int[] b, int[] c, int[] d, int s, int n, int[] w) {{
    switch (which) {{
{cases}    }}
  }}"""


def _ints(x) -> str:
    return ", ".join(str(int(v) - (int(v) >> 31 << 32)) for v in x)


_SOURCE = f"""
public class NAME implements org.apache.spark.sql.api.java.UDF6, java.io.Serializable {{
  static final int[] SINES = {{{_ints(_SINES)}}};
  static final int[] PLACES = {{{_ints(_PLACES[i // 16](i) for i in range(64))}}};
  static final int[] TURNS = {{{_ints(_TURNS[i // 16][i % 4] for i in range(64))}}};
  static final int CHUNK = 512;
{"".join(_steps(q) for q in range(4))}

  static void step(int i, int[] a, int[] b, int[] c, int[] d, int s, int n, int[] w) {{
    int which = i % 4 * 2 + (w == null ? 0 : 1);
    switch (i / 16) {{
      case 0: quarter0(which, a, b, c, d, s, n, w); break;
      case 1: quarter1(which, a, b, c, d, s, n, w); break;
      case 2: quarter2(which, a, b, c, d, s, n, w); break;
      default: quarter3(which, a, b, c, d, s, n, w);
    }}
  }}

  /* numbers, given as the first word of a digest as it lies in memory, modulo 100: in loops that are short enough */
  static void rest(int[] b, int[] r, int n) {{
    for (int j = 0; j < n; j++) {{ int h = b[j] + {_ints([_START[0]])}; r[j] = (h & 255) * 16 + ((h >>> 8) & 255) * 36; }}
    for (int j = 0; j < n; j++) {{ int h = b[j] + {_ints([_START[0]])}; r[j] += ((h >>> 16) & 255) * 56 + (h >>> 24); }}
    for (int j = 0; j < n; j++) {{ int h = r[j]; r[j] = h - ((h * 5243) >>> 19) * 100; }}
  }}

  static int below(int[] r, int from, int to, int limit) {{
    int n = 0;
    for (int j = from; j < to; j++) n += (r[j] - limit) >>> 31;
    return n;
  }}

  /* little-endian words of n texts of len bytes, moved by shift bytes from a word's start, each closed by 0x80 if asked */
  static int[][] words(byte[] raw, int n, int len, int shift, boolean close) {{
    int[][] out = new int[(shift + len + (close ? 1 : 0) + 3) / 4][n];
    for (int k = 0; k < n; k++) {{
      for (int i = 0; i < len; i++) out[(shift + i) / 4][k] |= (raw[k * len + i] & 255) << 8 * ((shift + i) % 4);
      if (close) out[(shift + len) / 4][k] |= 128 << 8 * ((shift + len) % 4);
    }}
    return out;
  }}

  static int[] ints(Object raw) {{
    java.nio.IntBuffer b = java.nio.ByteBuffer.wrap((byte[]) raw).order(java.nio.ByteOrder.LITTLE_ENDIAN).asIntBuffer();
    int[] out = new int[b.remaining()];
    b.get(out);
    return out;
  }}

  /* heads, tails: texts of one length each, without gaps. ends: of each head, the places among tails where its stretches
     begin, and the last one's end. codes: the class of each head. shape: numbers of heads, tails, bytes of a head, bytes
     of a tail, classes, bands, stretches, marks; the band of each stretch; whether it is near; close, far and bytes of
     the prefix of each mark. Returns rows (class, band, pairs, marked pairs by mark) for what has pairs. */
  public Object call(Object heads, Object tails, Object ends, Object codes, Object shape, Object prefixes) throws Exception {{
    byte[] head = (byte[]) heads, tail = (byte[]) tails, prefix = (byte[]) prefixes;
    int[] to = ints(ends), code = ints(codes), of = ints(shape);
    int rows = of[0], cols = of[1], own = of[2], other = of[3], classes = of[4], bands = of[5], parts = of[6], marks = of[7];
    long[][] found = new long[classes * bands][marks + 3];
    for (int i = 0; i < rows; i++)
      for (int k = 0; k < parts; k++) found[code[i] * bands + of[8 + k]][2] += to[i * (parts + 1) + k + 1] - to[i * (parts + 1) + k];
    int[] a = new int[CHUNK], b = new int[CHUNK], c = new int[CHUNK], d = new int[CHUNK], left = new int[CHUNK];
    int[][] state = new int[4][], near = new int[16][CHUNK], with = null;
    int shift = -1, start = 0;
    for (int m = 0; m < marks; m++) {{
      int at3 = 8 + 2 * parts + 3 * m, close = of[at3], far = of[at3 + 1], extra = of[at3 + 2], size = extra + own + other, whole = (extra + own) / 4;
      byte[] key = new byte[extra + own + other];
      System.arraycopy(prefix, start, key, 0, extra);
      start += extra;
      if (shift != (extra + own) % 4) {{ shift = (extra + own) % 4; with = words(tail, cols, other, shift, true); }}
      java.security.MessageDigest md5 = size > {BLOCK} ? java.security.MessageDigest.getInstance("MD5") : null;
      byte[] lead = new byte[extra + own];
      System.arraycopy(key, 0, lead, 0, extra);
      for (int i = 0; i < rows; i++) {{
        int row = i * (parts + 1), lo = to[row], hi = to[row + parts];
        if (lo >= hi) continue;
        System.arraycopy(head, i * own, lead, extra, own);
        int[][] word = words(lead, 1, lead.length, 0, false);
        int p = {_ints([_START[0]])}, q = {_ints([_START[1]])}, r = {_ints([_START[2]])}, s = {_ints([_START[3]])};
        if (md5 == null)
          for (int k = 0; k < whole; k++) {{  /* steps that whole words of the head decide */
            int t = p + (((r ^ s) & q) ^ s) + word[k][0] + SINES[k], turn = TURNS[k];
            p = s; s = r; r = q; q = q + ((t << turn) | (t >>> (32 - turn)));
          }}
        for (int x = lo; x < hi; x += CHUNK) {{
          int n = Math.min(CHUNK, hi - x);
          int[] hash;
          if (md5 == null) {{
            java.util.Arrays.fill(a, 0, n, p); java.util.Arrays.fill(b, 0, n, q);
            java.util.Arrays.fill(c, 0, n, r); java.util.Arrays.fill(d, 0, n, s);
            for (int k = 0; k < with.length; k++) System.arraycopy(with[k], x, near[k], 0, n);  /* loops from another place are not vectorised */
            state[0] = a; state[1] = b; state[2] = c; state[3] = d;
            for (int k = whole; k < 61; k++) {{
              int w = PLACES[k], add = SINES[k] + (w < word.length ? word[w][0] : 0) + (w == 14 ? 8 * size : 0);
              boolean both = w >= whole && w < whole + with.length;
              step(k, state[0], state[1], state[2], state[3], add, n, both ? near[w - whole] : null);
              int[] last = state[3];  /* what was a is b now */
              state[3] = state[2]; state[2] = state[1]; state[1] = state[0]; state[0] = last;
            }}
            hash = state[1];
          }} else {{
            hash = a;
            System.arraycopy(lead, 0, key, 0, lead.length);
            for (int j = 0; j < n; j++) {{
              System.arraycopy(tail, (x + j) * other, key, lead.length, other);
              byte[] digest = md5.digest(key);
              a[j] = ((digest[0] & 255) | (digest[1] & 255) << 8 | (digest[2] & 255) << 16 | (digest[3] & 255) << 24) - {_ints([_START[0]])};
            }}
          }}
          rest(hash, left, n);
          for (int k = 0; k < parts; k++) {{
            int from = Math.max(to[row + k], x), upto = Math.min(to[row + k + 1], x + n);
            if (from < upto) found[code[i] * bands + of[8 + k]][3 + m] += below(left, from - x, upto - x, of[8 + parts + k] != 0 ? close : far);
          }}
        }}
      }}
    }}
    int kept = 0;
    for (int k = 0; k < found.length; k++)
      if (found[k][2] > 0) {{ found[k][0] = k / bands; found[k][1] = k % bands; found[kept++] = found[k]; }}
    long[][] out = new long[kept][];
    System.arraycopy(found, 0, out, 0, kept);
    return out;
  }}
}}
"""

NAME = "limen_marked"


def registered(spark: SparkSession) -> bool:
    """The function limen_marked of the session, made if need be; False where the JVM cannot be reached."""
    try:
        jvm = spark.sparkContext._jvm
    except Exception:  # Spark Connect
        return False
    if not spark.catalog.functionExists(NAME):
        name = "LimenMarked"
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(_SOURCE.replace("NAME", name))
        path = os.path.join(tempfile.mkdtemp(prefix="limen-jar-"), f"{uuid.uuid4().hex}.jar")  # a context takes a name once
        with zipfile.ZipFile(path, "w") as jar:
            for cls, code in compiler.getBytecodes().items():
                jar.writestr(cls.replace(".", "/") + ".class", bytes(code))
        spark.sql(f"ADD JAR '{path}'")
        none = lambda cls: spark.sparkContext._gateway.new_array(cls, 0)
        made = spark._jsparkSession.sharedState().jarClassLoader().loadClass(name).getDeclaredConstructor(none(jvm.Class)).newInstance(none(jvm.Object))
        spark._jsparkSession.udf().register(NAME, made, jvm.org.apache.spark.sql.types.DataType.fromDDL("array<array<bigint>>"))
    return True


def shape(rows: int, cols: int, own: int, other: int, classes: int, bands: int, band: list[int], near: list[bool], marks: list[tuple[str, int, int]]) -> bytes:
    """The function's fifth argument, as its source has it; the sixth is the prefixes of marks without gaps."""
    return np.array([rows, cols, own, other, classes, bands, len(band), len(marks), *band, *near, *[x for p, close, far in marks for x in (close, far, len(p.encode()))]], "<i4").tobytes()
