"""Queries over scalar expressions."""

from pyspark.sql import functions as F

from phasemill.catalog.registry import query
from phasemill.functions import columns as c
from phasemill.functions.columns import r6
from phasemill.sources import views

PI2 = "(2 * pi())"


@query(
    "classify_direction",
    """SELECT event_id, CASE WHEN starts_with(l, 'lr') THEN 'azi_fwd' WHEN starts_with(l, 'rl') THEN 'azi_rev'
         WHEN starts_with(l, 'tb') THEN 'alt_fwd' WHEN starts_with(l, 'bt') THEN 'alt_rev'
         WHEN starts_with(l, 'ccw') THEN 'azi_rev' WHEN starts_with(l, 'cw') THEN 'azi_fwd'
         WHEN starts_with(l, 'expand') THEN 'alt_fwd' WHEN starts_with(l, 'contract') THEN 'alt_rev' END AS direction
       FROM (SELECT event_id, lower(list_extract(['LR','rl_2','TB','Bt','CW','ccw-1','Expand','contracting','blank'],
         CAST(event_id % 9 + 1 AS INTEGER)) || event_type) AS l FROM events)""",
)
def _(spark, d):
    names = F.array(*[F.lit(s) for s in ("LR", "rl_2", "TB", "Bt", "CW", "ccw-1", "Expand", "contracting", "blank")])
    label = F.concat(F.element_at(names, (F.col("event_id") % 9 + 1).cast("int")), "event_type")
    return views.table(spark, d, "events").select("event_id", c.classify_direction(label).alias("direction"))


@query(
    "normalize",
    """SELECT vec_id, round((v - f0) / greatest(f0, 0.9), 6) + 0.0 AS fractional, round(v - f0, 6) + 0.0 AS absolute,
         round(greatest(v - f0, 0), 6) + 0.0 AS rectified
       FROM (SELECT vec_id, CAST(1 + embedding[1] AS DOUBLE) AS v, CAST(1 + embedding[2] AS DOUBLE) AS f0 FROM
         (SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS embedding FROM embeddings))""",
)
def _(spark, d):
    e = views.table(spark, d, "embeddings").select(
        "vec_id", (F.lit(1.0) + F.col("embedding")[0].cast("double")).alias("v"),
        (F.lit(1.0) + F.col("embedding")[1].cast("double")).alias("f0"), F.lit(0.9).alias("floor"),
    )
    return e.select(
        "vec_id", r6(c.normalize("v", "f0", "floor")).alias("fractional"),
        r6(c.normalize("v", "f0", "floor", "absolute")).alias("absolute"),
        r6(c.rectify(c.normalize("v", "f0", "floor", "absolute"), "half_wave")).alias("rectified"),
    )


@query(
    "complex_kit",
    """SELECT rec_id, y, x, round(sqrt(v*v + w*w), 6) + 0.0 AS mag, round(cos(atan2(w, v)), 6) + 0.0 AS arg_cos,
         round(sin(atan2(w, v)), 6) + 0.0 AS arg_sin, round(v*cos(0.7) - w*sin(0.7), 6) + 0.0 AS rot_re,
         round(v*sin(0.7) + w*cos(0.7), 6) + 0.0 AS rot_im, round(v*2.5, 6) + 0.0 AS sc_re, round(w*2.5, 6) + 0.0 AS sc_im,
         round(cos(alt), 6) + 0.0 AS ph_re, round(sin(alt), 6) + 0.0 AS ph_im
       FROM v_raster""",
    "v_raster",
)
def _(spark, d):
    r = views.raster(spark, d)
    rot, sc, ph = c.c_rotate("v", "w", F.lit(0.7)), c.c_scale("v", "w", F.lit(2.5)), c.c_from_phase("alt")
    a = c.c_arg("v", "w")
    return r.select(
        "rec_id", "y", "x", r6(c.c_abs("v", "w")).alias("mag"), r6(F.cos(a)).alias("arg_cos"), r6(F.sin(a)).alias("arg_sin"),
        r6(rot[0]).alias("rot_re"), r6(rot[1]).alias("rot_im"), r6(sc[0]).alias("sc_re"), r6(sc[1]).alias("sc_im"),
        r6(ph[0]).alias("ph_re"), r6(ph[1]).alias("ph_im"),
    )


@query(
    "wrap_angles",
    """SELECT rec_id, y, x, round(atan2(sin(alt), cos(alt)), 6) + 0.0 AS wrapped,
         round(least(m, 360 - m), 6) + 0.0 AS distance
       FROM (SELECT *, (((alt*9 - azi*11) % 360.0) + 360.0) % 360.0 AS m FROM v_raster)""",
    "v_raster",
)
def _(spark, d):
    r = views.raster(spark, d)
    dist = c.wrap_distance(F.col("alt") * 9, F.col("azi") * 11, 360.0)
    return r.select("rec_id", "y", "x", r6(c.wrap_principal("alt")).alias("wrapped"), r6(dist).alias("distance"))


@query(
    "phase_to_degrees",
    f"SELECT rec_id, y, x, round(v * 140 / {PI2} + 12.5, 6) + 0.0 AS deg FROM v_raster",
    "v_raster",
)
def _(spark, d):
    return views.raster(spark, d).select(
        "rec_id", "y", "x", r6(c.phase_to_degrees("v", F.lit(140.0), F.lit(12.5))).alias("deg")
    )


@query(
    "eccentricity_forms",
    """SELECT rec_id, y, x,
         round(degrees(atan(sqrt(power(tan(da), 2) + power(tan(dz), 2) / greatest(power(cos(da), 2), 1e-12)))), 6) + 0.0 AS ecc_alt,
         round(degrees(atan(sqrt(power(tan(dz), 2) + power(tan(da), 2) / power(cos(dz), 2)))), 6) + 0.0 AS ecc_azi,
         round(degrees(atan2(alt - 2.0, azi + 3.0)), 6) + 0.0 AS polar
       FROM (SELECT *, radians(alt - 2.0) AS da, radians(azi + 3.0) AS dz FROM v_raster)""",
    "v_raster",
)
def _(spark, d):
    args = ("alt", "azi", F.lit(2.0), F.lit(-3.0))
    return views.raster(spark, d).select(
        "rec_id", "y", "x", r6(c.ecc_alt(*args)).alias("ecc_alt"), r6(c.ecc_azi(*args)).alias("ecc_azi"),
        r6(c.polar_angle(*args)).alias("polar"),
    )


@query(
    "label_roi",
    """SELECT rec_id, y, x, round(CASE WHEN label > 0 THEN alt ELSE 0 END, 6) + 0.0 AS alt_roi,
         round(CASE WHEN label > 0 THEN 1 / greatest(det, 1e-12) ELSE 0 END, 6) + 0.0 AS mag_factor FROM v_raster""",
    "v_raster",
)
def _(spark, d):
    return views.raster(spark, d).select(
        "rec_id", "y", "x", r6(c.label_roi("alt", "label")).alias("alt_roi"),
        r6(c.magnification_factor("det", "label")).alias("mag_factor"),
    )


@query(
    "rot90",
    """SELECT rec_id, k, CASE WHEN k IN (1, 3) THEN width ELSE height END AS height,
         CASE WHEN k IN (1, 3) THEN height ELSE width END AS width,
         CASE k WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN height - 1 - y ELSE width - 1 - x END AS y,
         CASE k WHEN 0 THEN x WHEN 1 THEN height - 1 - y WHEN 2 THEN width - 1 - x ELSE y END AS x,
         round(v, 6) + 0.0 AS v
       FROM v_raster, range(4) t(k)""",
    "v_raster",
)
def _(spark, d):
    from phasemill.operators.maps import rot90

    r = views.raster(spark, d).select("rec_id", "height", "width", "y", "x", "v")
    r = r.withColumn("k", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(4)])))
    return rot90(r, "k").select("rec_id", "k", "height", "width", "y", "x", r6("v").alias("v"))


@query(
    "bar_position",
    """SELECT l_orderkey, l_linenumber, round(CASE WHEN st = 2 AND lab <> 'BLANK' THEN CAST(ctr + (CASE WHEN lab IN ('LR', 'BT')
           THEN pr * (ext + wd) - (ext * CAST(0.5 AS FLOAT) + wd * CAST(0.5 AS FLOAT))
           ELSE (ext * CAST(0.5 AS FLOAT) + wd * CAST(0.5 AS FLOAT)) - pr * (ext + wd) END) AS DOUBLE) END, 6) + 0.0 AS pos,
         NOT (st = 2 AND lab <> 'BLANK') AS is_nan
       FROM (SELECT l_orderkey, l_linenumber, l_orderkey % 3 + 1 AS st,
           list_extract(['LR','RL','TB','BT','BLANK'], CAST(l_partkey % 5 + 1 AS INTEGER)) AS lab,
           CAST(l_discount AS FLOAT) AS pr, CAST(l_quantity + 60 AS FLOAT) AS ext, CAST(20 AS FLOAT) AS wd,
           CAST(l_tax * 10 AS FLOAT) AS ctr FROM lineitem)""",
)
def _(spark, d):
    labels = F.array(*[F.lit(s) for s in ("LR", "RL", "TB", "BT", "BLANK")])
    s = views.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_orderkey") % 3 + 1).alias("st"),
        F.element_at(labels, (F.col("l_partkey") % 5 + 1).cast("int")).alias("lab"),
        F.col("l_discount").alias("pr"), (F.col("l_quantity") + 60).alias("ext"), (F.col("l_tax") * 10).alias("ctr"),
    )
    p = c.bar_position("st", "lab", "pr", "ext", F.lit(20.0), "ctr")
    return s.select(
        "l_orderkey", "l_linenumber", r6(F.when(~F.isnan(p), p)).alias("pos"), F.isnan(p).alias("is_nan")
    )


_ANGLES = """SELECT *, (u - 0.5) * width_cm - bisector_x AS rt, (0.5 - v) * height_cm - bisector_y AS upw FROM v_geometry"""


@query(
    "screen_to_angle",
    f"""SELECT rig_id, round(azi0 + degrees(CASE projection WHEN 'cylindrical' THEN rt / distance ELSE atan(rt / distance) END), 6) + 0.0 AS azi,
          round(alt0 + degrees(CASE projection WHEN 'spherical' THEN asin(upw / sqrt(distance*distance + rt*rt + upw*upw))
            ELSE atan(upw / distance) END), 6) + 0.0 AS alt,
          round(u, 6) + 0.0 AS u_back, round(v, 6) + 0.0 AS v_back FROM ({_ANGLES})""",
    "v_geometry",
)
def _(spark, d):
    g = views.geometry(spark, d)
    s = c.Screen("projection", "distance", "width_cm", "height_cm", None, None, "azi0", "alt0", "bisector_x", "bisector_y")
    azi, alt = s.to_angle("u", "v")
    g = g.withColumn("azi", azi).withColumn("alt", alt)
    u, v = s.to_screen("azi", "alt")  # the exact inverse must give the start back
    return g.select("rig_id", r6("azi").alias("azi"), r6("alt").alias("alt"), r6(u).alias("u_back"), r6(v).alias("v_back"))


@query(
    "angle_to_screen",
    """SELECT rig_id, round(((CASE projection WHEN 'cylindrical' THEN distance * a ELSE rt END) + bisector_x) / width_cm + 0.5, 6) + 0.0 AS u,
         round((0.5 - ((CASE projection WHEN 'spherical' THEN sqrt(distance*distance + rt*rt) ELSE distance END) * tan(e) + bisector_y) / height_cm) * 1080, 6) + 0.0 AS py,
         round(10 / CASE projection WHEN 'cylindrical' THEN degrees(width_cm / distance) ELSE 2 * degrees(atan(width_cm / 2 / distance)) END * 1920, 6) + 0.0 AS px_10deg,
         round(CAST(50 AS DOUBLE) / 1080 * 2 * degrees(atan(height_cm / 2 / distance)), 6) + 0.0 AS deg_50px
       FROM (SELECT *, distance * tan(a) AS rt FROM (SELECT *, radians(u * 40 - azi0) AS a, radians(v * 30 - alt0) AS e FROM v_geometry))""",
    "v_geometry",
)
def _(spark, d):
    g = views.geometry(spark, d)
    s = c.Screen("projection", "distance", "width_cm", "height_cm", 1920, 1080, "azi0", "alt0", "bisector_x", "bisector_y")
    azi, alt = F.col("u") * 40.0, F.col("v") * 30.0
    return g.select(
        "rig_id", r6(s.to_screen(azi, alt)[0]).alias("u"), r6(s.to_screen_px(azi, alt)[1]).alias("py"),
        r6(s.deg_to_px(F.lit(10.0))).alias("px_10deg"), r6(s.px_to_deg(F.lit(50.0), False)).alias("deg_50px"),
    )


_FIELD = """SELECT *, CASE projection WHEN 'cylindrical' THEN degrees(width_cm / distance)
      ELSE 2 * degrees(atan(width_cm / 2 / distance)) END AS fw, 2 * degrees(atan(height_cm / 2 / distance)) AS fh,
    greatest(0, (SELECT max(degrees(atan2(sqrt(power((cu - 0.5) * width_cm - bisector_x - tan(radians(azi0)) * distance, 2)
      + power((0.5 - cv) * height_cm - bisector_y - tan(radians(alt0)) * distance, 2)), distance)))
      FROM (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) t(cu, cv))) AS ecc FROM v_geometry"""


@query(
    "visual_field",
    f"SELECT rig_id, round(fw, 6) + 0.0 AS field_w, round(fh, 6) + 0.0 AS field_h, round(ecc, 6) + 0.0 AS max_ecc FROM ({_FIELD})",
    "v_geometry",
)
def _(spark, d):
    g = views.geometry(spark, d)
    s = c.Screen("projection", "distance", "width_cm", "height_cm", None, None, "azi0", "alt0", "bisector_x", "bisector_y")
    return g.select(
        "rig_id", r6(s.field_width()).alias("field_w"), r6(s.field_height()).alias("field_h"),
        r6(s.max_eccentricity()).alias("max_ecc"),
    )


@query(
    "sweep_duration",
    f"""SELECT rig_id, round(sec, 6) + 0.0 AS sweep_sec,
          round(3 + 4 * reps * sec + (4 * reps - 1) * 0.75 + 3 * 1.5 * reps + 2, 6) + 0.0 AS session_sec
        FROM (SELECT rig_id, rig_id % 5 + 1 AS reps, CASE envelope WHEN 'bar' THEN (fw + width_deg) / speed WHEN 'wedge' THEN 360 / speed
            WHEN 'ring' THEN (ecc + width_deg) / speed ELSE 0 END AS sec FROM ({_FIELD}))""",
    "v_geometry",
)
def _(spark, d):
    g = views.geometry(spark, d)
    s = c.Screen("projection", "distance", "width_cm", "height_cm", None, None, "azi0", "alt0", "bisector_x", "bisector_y")
    g = g.withColumn(
        "sec", c.sweep_duration("envelope", "width_deg", "speed", "speed", "speed", s.field_width(), s.max_eccentricity())
    )
    reps = F.col("rig_id") % 5 + 1
    total = c.session_duration("sec", F.lit(4), reps, F.lit(0.75), F.lit(1.5), F.lit(3.0), F.lit(2.0))
    return g.select("rig_id", r6("sec").alias("sweep_sec"), r6(total).alias("session_sec"))


@query(
    "um_per_pixel",
    "SELECT p_partkey, round(p_retailprice / 100 * 1000 / (2 * (p_size + 100)), 6) + 0.0 AS um FROM part",
)
def _(spark, d):
    return views.table(spark, d, "part").select(
        "p_partkey", r6(c.um_per_pixel(F.col("p_retailprice") / 100, F.col("p_size") + 100.0)).alias("um")
    )


@query(
    "state_name",
    """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'idle' WHEN 1 THEN 'baseline_start' WHEN 2 THEN 'stimulus'
         WHEN 3 THEN 'inter_stimulus' WHEN 4 THEN 'inter_direction' WHEN 5 THEN 'baseline_end' WHEN 6 THEN 'complete' END AS state
       FROM events""",
)
def _(spark, d):
    return views.table(spark, d, "events").select("event_id", c.state_name(F.col("event_id") % 8).alias("state"))


@query(
    "finite_guard",
    """SELECT l_returnflag, count(*) AS n_finite, round(sum(q), 4) + 0.0 AS total FROM
         (SELECT l_returnflag, l_quantity AS q FROM lineitem WHERE l_linenumber % 3 = 0) GROUP BY l_returnflag""",
)
def _(spark, d):
    # two of three rows carry NaN or infinity and must not pass the guard
    q = (
        F.when(F.col("l_linenumber") % 3 == 1, F.lit(float("nan")))
        .when(F.col("l_linenumber") % 3 == 2, F.lit(float("inf"))).otherwise(F.col("l_quantity"))
    )
    li = views.table(spark, d, "lineitem").select("l_returnflag", q.alias("q")).filter(c.finite("q"))
    return li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_finite"), r6(F.sum("q"), 4).alias("total"))


@query(
    "display_fraction",
    """SELECT rec_id, y, x, round(CASE WHEN label = 0 THEN NULL ELSE greatest(0, least(1, (alt + 10) / 20)) END, 6) + 0.0 AS linear,
         round((((alt + 10) % 7.0 + 7.0) % 7.0) / 7, 6) + 0.0 AS circular FROM v_raster""",
    "v_raster",
)
def _(spark, d):
    r = views.raster(spark, d)
    roi = F.when(F.col("label") > 0, F.col("alt")).otherwise(0.0)
    return r.select(
        "rec_id", "y", "x",
        r6(c.display_fraction(roi, F.lit(-10.0), F.lit(10.0), F.lit(0.0), F.lit("outside"))).alias("linear"),
        r6(c.display_fraction("alt", F.lit(-10.0), F.lit(10.0), F.lit(7.0), F.lit(""))).alias("circular"),
    )
