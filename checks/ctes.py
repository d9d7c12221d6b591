"""SQL text of the fixture views and of shared steps, as DuckDB CTEs."""

import re

CTES = {}

CTES["listing"] = r"""
SELECT root, dir || name AS rel_path,
       CAST(1600000000000000000 + o_orderkey * 1000000007 AS bigint) AS mtime_ns,
       size, o_orderkey
FROM (
  SELECT o_orderkey, k,
    '/cards/c' || CAST(o_custkey % 7 AS string) AS root,
    CASE WHEN o_orderkey % 40 = 3 THEN '.trash/' WHEN o_orderkey % 4 = 0 THEN ''
         WHEN o_orderkey % 4 = 1 THEN 'day1/' WHEN o_orderkey % 4 = 2 THEN 'day1-b/' ELSE 'day2/sub/' END AS dir,
    CASE k WHEN 0 THEN stem || '.' || CASE o_orderkey % 6 WHEN 0 THEN 'NEF' WHEN 1 THEN 'CR3' WHEN 2 THEN 'arw' WHEN 3 THEN 'Dng' WHEN 4 THEN 'gpr' ELSE 'RAF' END
           WHEN 1 THEN lower(stem) || '.JPG' WHEN 2 THEN stem || '.jpeg' WHEN 3 THEN stem || '.DNG'
           WHEN 4 THEN '.' || stem || '.NEF' WHEN 5 THEN stem || '.txt' ELSE stem END AS name,
    CAST(floor(o_totalprice * 100) AS bigint) + k AS size
  FROM (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN '_MG_' ELSE 'IMG_' END || lpad(CAST(o_orderkey AS string), 8, '0') AS stem FROM orders) o
  CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6)) v(k)
  WHERE k = 0 OR (k = 1 AND o_orderkey % 3 = 0) OR (k = 2 AND o_orderkey % 30 = 0) OR (k = 3 AND o_orderkey % 42 = 0)
     OR (k = 4 AND o_orderkey % 50 = 0) OR (k = 5 AND o_orderkey % 10 = 0) OR (k = 6 AND o_orderkey % 100 = 0)
) f
"""

CTES["photos_index"] = r"""
SELECT o_orderkey * 2 + g + 1 AS id, root,
       CASE WHEN g = 1 THEN 'GONE_' || CAST(o_orderkey AS string) || '.NEF' ELSE rel_path END AS rel_path,
       mtime_ns - CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS mtime_ns,
       size + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS size,
       CASE WHEN o_orderkey % 23 = 0 THEN 3 WHEN o_orderkey % 10 = 1 THEN 2 WHEN o_orderkey % 10 IN (2, 3) THEN 0 ELSE 1 END AS status,
       CAST(o_orderkey % 6 AS int) AS label, CAST(o_orderkey % 4 AS int) AS rot_cw,
       CASE WHEN o_orderkey % 19 = 0 THEN 'old.jpg' END AS jpeg_rel_path
FROM listing CROSS JOIN (VALUES (0),(1)) w(g)
WHERE lower(rel_path) NOT LIKE '%.jp%g' AND rel_path NOT LIKE '%.txt' AND rel_path LIKE '%.%' AND rel_path NOT LIKE '%.DNG'
  AND rel_path NOT LIKE '.%' AND rel_path NOT LIKE '%/.%' AND rel_path NOT LIKE '%.gpr' AND o_orderkey % 9 <> 0
  AND (g = 0 OR o_orderkey % 17 = 0)
"""

CTES["photos"] = r"""
SELECT id,
  root,
  rel_path,
  mtime_ns,
  size,
  CASE WHEN id % 20 = 1 THEN NULL ELSE 4000 + id % 3 * 1000 END AS width,
  CASE WHEN id % 25 = 1 THEN NULL ELSE 3000 + id % 2 * 1000 END AS height,
  CAST(1 + id % 8 AS int) AS orientation,
  rot_cw,
  CASE WHEN id % 4 <> 3 THEN 'Camera ' || CAST(id % 5 AS string) END AS camera,
  CASE WHEN id % 6 <> 5 THEN 'Lens ' || CAST(id % 3 AS string) END AS lens,
  CASE WHEN id % 7 <> 2 THEN '2024-05-' || lpad(CAST(1 + id % 28 AS string), 2, '0') || ' 10:00:00' END AS taken_at,
  CASE WHEN id % 9 <> 4 THEN '1/250 s' END AS shutter,
  CASE WHEN id % 8 <> 5 THEN CAST(10 + id % 30 AS double) / 10 END AS aperture,
  CASE WHEN id % 10 <> 3 THEN 100 * (1 + id % 12) END AS iso,
  CASE WHEN id % 11 <> 7 THEN CAST(id % 600 AS double) / 4 END AS focal_mm,
  label,
  status,
  CASE WHEN status = 2 THEN 'cannot read ' || rel_path END AS err_msg,
  CASE WHEN status = 1 THEN 'previews/' || md5(root || '/' || rel_path) || '.jpg' END AS preview_path,
  CASE WHEN status = 1 THEN 'thumbs/' || md5(root || '/' || rel_path) || '.jpg' END AS thumb_path,
  jpeg_rel_path,
  CASE WHEN status = 1 THEN 1700000000000 + id END AS ingested_at
FROM photos_index
"""

CTES["stored_rows"] = r"""
SELECT id,
  root,
  rel_path,
  mtime_ns,
  size,
  CASE WHEN id % 13 = 1 THEN -width WHEN id % 13 = 2 THEN 5000000000 ELSE width END AS width,
  CASE WHEN id % 17 = 1 THEN -height ELSE height END AS height,
  CAST(CASE WHEN id % 10 = 1 THEN 70000 WHEN id % 10 = 3 THEN -2 ELSE orientation END AS int) AS orientation,
  CAST(rot_cw + CASE WHEN id % 5 = 1 THEN 7 WHEN id % 5 = 2 THEN -9 ELSE 0 END AS int) AS rot_cw,
  camera,
  lens,
  taken_at,
  shutter,
  aperture,
  CASE WHEN id % 14 = 1 THEN -iso WHEN id % 14 = 3 THEN 5000000000 ELSE iso END AS iso,
  focal_mm,
  CAST(CASE WHEN id % 11 = 1 THEN 9 WHEN id % 11 = 2 THEN -1 ELSE label END AS int) AS label,
  CAST(CASE WHEN id % 15 = 1 THEN 4 WHEN id % 15 = 3 THEN -3 ELSE status END AS int) AS status,
  err_msg,
  preview_path,
  thumb_path,
  jpeg_rel_path,
  ingested_at
FROM photos
"""

CTES["exif_raw"] = r"""
SELECT o_orderkey * 2 + 1 AS id,
  CASE o_orderkey % 5 WHEN 0 THEN ' Canon ' WHEN 1 THEN 'NIKON CORPORATION' WHEN 2 THEN 'SONY' WHEN 3 THEN '' ELSE '  ' END AS make,
  CASE o_orderkey % 4 WHEN 0 THEN 'R5 ' WHEN 1 THEN 'Z 8' WHEN 2 THEN '' ELSE 'ILCE-7M4' END AS model,
  CASE o_orderkey % 3 WHEN 0 THEN ' RF 24-70mm ' WHEN 1 THEN '' END AS lens_model,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Detected 50mm' END AS lens_name,
  CAST(CASE o_orderkey % 11 WHEN 10 THEN NULL ELSE o_orderkey % 11 END AS int) AS orientation,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL WHEN o_orderkey % 8 = 1 THEN ' unknown ' ELSE '2024:05:' || lpad(CAST(1 + o_orderkey % 28 AS string), 2, '0') || ' 12:33:44' END AS date_time_original,
  CASE WHEN o_orderkey % 16 = 0 THEN '2023:01:02' END AS create_date,
  CASE WHEN o_orderkey % 5 <> 0 THEN CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 40 ELSE 1 END END AS exposure_n,
  CASE WHEN o_orderkey % 5 <> 0 THEN CASE WHEN o_orderkey % 7 = 0 THEN 4 ELSE o_orderkey % 8000 END END AS exposure_d,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 12 END AS apex_shutter_n, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 3 END AS apex_shutter_d,
  CASE WHEN o_orderkey % 3 <> 0 THEN 14 + o_orderkey % 200 END AS fnumber_n, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 4) * 10 END AS fnumber_d,
  CASE WHEN o_orderkey % 4 <> 1 THEN o_orderkey % 900 END AS apex_aperture_n, CASE WHEN o_orderkey % 4 <> 1 THEN 100 END AS apex_aperture_d,
  CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 9) * 100 END AS iso_ratings, CASE WHEN o_orderkey % 3 = 1 THEN 3200 END AS iso_speed, CASE WHEN o_orderkey % 2 = 0 THEN 100 END AS rei,
  o_orderkey % 600 AS focal_n, o_orderkey % 5 AS focal_d,
  CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE 6000 END AS width, CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE 4000 END AS height
FROM orders
"""

CTES["label_events"] = r"""
SELECT event_id, ts, user_id * 2 + 1 AS id,
  CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 WHEN 'signup' THEN 4 ELSE 0 END AS label
FROM events
"""

CTES["rotation_events"] = r"""
SELECT event_id, ts, user_id * 2 + 1 AS id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS delta FROM events
"""

CTES["ingest_events"] = r"""
SELECT event_id, ts, 'job' || CAST(user_id % 3 AS string) AS job,
  CAST(greatest(floor(event_id / 100.0) - CASE WHEN event_id % 37 = 0 THEN 1 ELSE 0 END, 0) AS bigint) AS generation,
  user_id * 2 + 1 AS id, CASE WHEN event_type = 'error' THEN 'Failed' ELSE 'Ingested' END AS kind
FROM events
"""

CTES["ingest_batches"] = r"""
SELECT job, generation, generation * 100 AS started_event_id,
  count(*) + CASE WHEN generation % 4 = 0 THEN 1 ELSE 0 END AS enqueued
FROM ingest_events GROUP BY job, generation
"""

CTES["progress_ticks"] = r"""
SELECT job, event_id, event_id - CASE WHEN event_id % 5 = 0 THEN 40 ELSE 0 END AS done FROM ingest_events
"""

CTES["root_opens"] = r"""
SELECT '/cards/c' || CAST(user_id % 7 AS string) AS path, event_id * 1000 AS opened_at FROM events
"""

CTES["scanned_roots"] = r"""
SELECT DISTINCT root, root <> '/cards/c3' AS recursive FROM photos_index WHERE root <> '/cards/c5'
"""

CTES["selection"] = r"""
SELECT id FROM photos_index WHERE id % 5 = 0 AND root <> '/cards/c2'
"""

CTES["dest_files"] = r"""
SELECT DISTINCT regexp_extract(rel_path, '([^/]*)$', 1) AS name FROM listing WHERE o_orderkey % 25 = 0
"""

CTES["cache_files"] = r"""
SELECT id, kind, md5(root || '/' || rel_path) AS hash, 1000 + (id * CASE WHEN kind = 'preview' THEN 31 ELSE 7 END) % 5000 AS bytes,
  (id * 7919) % 100003 AS last_used, CASE WHEN status = 1 AND id % 12 <> 5 THEN 1 ELSE 0 END AS keep
FROM photos_index CROSS JOIN (VALUES ('preview'), ('thumb')) t(kind)
"""

CTES["cursors"] = r"""
SELECT root, id AS session, id % 997 AS anchor, id * 7 % 1999 AS clicked FROM photos_index WHERE id % 500 = 1
"""

# Candidate files of a scan with their path parts.
CTES["candidates"] = r"""
SELECT root, rel_path, mtime_ns, size,
  regexp_replace(rel_path, '/?[^/]*$', '') AS dir,
  lower(regexp_replace(regexp_extract(rel_path, '([^/]*)$', 1), '\.[^.]*$', '')) AS stem,
  lower(regexp_extract(rel_path, '\.([^./]*)$', 1)) AS ext
FROM listing
WHERE NOT (rel_path LIKE '.%' OR rel_path LIKE '%/.%')
"""

CTES["scan_all"] = r"""
SELECT r.root, r.rel_path, r.mtime_ns, r.size, CASE WHEN r.rn = 1 THEN j.jpeg END AS jpeg_rel_path
FROM (SELECT *, row_number() OVER (PARTITION BY root, dir, stem ORDER BY rel_path) AS rn
      FROM candidates WHERE ext IN ('nef', 'cr3', 'arw', 'dng', 'raf')) r
LEFT JOIN (SELECT root, dir, stem, min(rel_path) AS jpeg FROM candidates
           WHERE ext IN ('jpg', 'jpeg') GROUP BY root, dir, stem) j
  ON r.root = j.root AND r.dir = j.dir AND r.stem = j.stem
"""

# The same scan limited to the scanned roots, shallow where they say so.
CTES["scan_scoped"] = r"""
SELECT s.* FROM scan_all s JOIN scanned_roots q ON s.root = q.root
WHERE q.recursive OR s.rel_path NOT LIKE '%/%'
"""

CTES["diff"] = r"""
SELECT coalesce(s.root, i.root) AS root, coalesce(s.rel_path, i.rel_path) AS rel_path,
  s.mtime_ns AS new_mtime_ns, s.size AS new_size, s.jpeg_rel_path AS new_jpeg_rel_path,
  i.* EXCLUDE (root, rel_path),
  CASE WHEN i.id IS NULL THEN 'insert'
       WHEN s.rel_path IS NOT NULL AND (i.status = 3 OR i.mtime_ns <> s.mtime_ns OR i.size <> s.size) THEN 'reset'
       WHEN s.rel_path IS NOT NULL AND i.jpeg_rel_path IS DISTINCT FROM s.jpeg_rel_path THEN 'reattach'
       WHEN s.rel_path IS NOT NULL THEN 'keep'
       WHEN q.root IS NULL OR (NOT q.recursive AND i.rel_path LIKE '%/%') THEN 'out_of_scope'
       WHEN i.status = 3 THEN 'still_missing'
       ELSE 'mark_missing' END AS action
FROM scan_scoped s FULL JOIN photos i ON s.root = i.root AND s.rel_path = i.rel_path
LEFT JOIN scanned_roots q ON q.root = coalesce(s.root, i.root)
"""

CTES["synced"] = r"""
SELECT id, root, rel_path,
  CASE WHEN action = 'reset' THEN new_mtime_ns ELSE mtime_ns END AS mtime_ns,
  CASE WHEN action = 'reset' THEN new_size ELSE size END AS size,
  CASE WHEN action <> 'reset' THEN width END AS width,
  CASE WHEN action <> 'reset' THEN height END AS height,
  CAST(CASE WHEN action = 'reset' THEN 1 ELSE orientation END AS int) AS orientation, rot_cw,
  CASE WHEN action <> 'reset' THEN camera END AS camera,
  CASE WHEN action <> 'reset' THEN lens END AS lens,
  CASE WHEN action <> 'reset' THEN taken_at END AS taken_at,
  CASE WHEN action <> 'reset' THEN shutter END AS shutter,
  CASE WHEN action <> 'reset' THEN aperture END AS aperture,
  CASE WHEN action <> 'reset' THEN iso END AS iso,
  CASE WHEN action <> 'reset' THEN focal_mm END AS focal_mm,
  label,
  CAST(CASE WHEN action = 'reset' THEN 0 WHEN action = 'mark_missing' THEN 3 ELSE status END AS int) AS status,
  CASE WHEN action <> 'reset' THEN err_msg END AS err_msg,
  CASE WHEN action <> 'reset' THEN preview_path END AS preview_path,
  CASE WHEN action <> 'reset' THEN thumb_path END AS thumb_path,
  CASE WHEN action IN ('reset', 'reattach') THEN new_jpeg_rel_path ELSE jpeg_rel_path END AS jpeg_rel_path,
  CASE WHEN action <> 'reset' THEN ingested_at END AS ingested_at
FROM diff WHERE action <> 'insert'
UNION ALL BY NAME
SELECT (SELECT max(id) FROM photos) + row_number() OVER (ORDER BY root, string_split(rel_path, '/')) AS id,
  root, rel_path, new_mtime_ns AS mtime_ns, new_size AS size, CAST(1 AS int) AS orientation,
  CAST(0 AS int) AS rot_cw, CAST(0 AS int) AS label, CAST(0 AS int) AS status, new_jpeg_rel_path AS jpeg_rel_path
FROM diff WHERE action = 'insert'
"""

CTES["live"] = "SELECT * FROM photos WHERE status <> 3"

# Display order by file name over the labelled, live rows (mask 0b111110).
CTES["view_name"] = r"""
SELECT *, row_number() OVER (PARTITION BY root ORDER BY lower(regexp_extract(rel_path, '([^/]*)$', 1)),
                             string_split(rel_path, '/')) - 1 AS pos
FROM live WHERE label BETWEEN 1 AND 5
"""

# Display order by capture time over all live rows.
CTES["view_time"] = r"""
SELECT *, row_number() OVER (PARTITION BY root ORDER BY taken_at ASC NULLS LAST, string_split(rel_path, '/')) - 1 AS pos
FROM live
"""

CTES["scope"] = r"""
SELECT v.* FROM view_name v
WHERE v.id IN (SELECT id FROM selection)
   OR v.root NOT IN (SELECT p.root FROM photos p JOIN selection s ON p.id = s.id)
"""

CTES["files"] = r"""
SELECT root, pos * 2 + side AS ordinal, id, root || '/' || file AS source,
  regexp_extract(file, '([^/]*)$', 1) AS name
FROM (SELECT root, pos, id, 0 AS side, rel_path AS file FROM scope
      UNION ALL SELECT root, pos, id, 1 AS side, jpeg_rel_path AS file FROM scope) f
WHERE file IS NOT NULL
"""

# The same files under colliding names, as several cards would produce them.
CTES["clashing"] = r"""
SELECT root, ordinal, id, source,
  'IMG_' || lpad(CAST(id % 400 AS string), 4, '0') || '.' || lower(regexp_extract(name, '\.([^.]*)$', 1)) AS name
FROM files
"""

CTES["exif"] = r"""
SELECT id, CAST(width AS bigint) AS width, CAST(height AS bigint) AS height,
  CAST(CASE WHEN orientation BETWEEN 1 AND 8 THEN orientation ELSE 1 END AS int) AS orientation,
  nullif(trim(trim(make) || ' ' || trim(model)), '') AS camera,
  coalesce(nullif(trim(lens_model), ''), nullif(trim(lens_name), '')) AS lens,
  regexp_replace(trim(CASE WHEN date_time_original IS NULL THEN create_date ELSE date_time_original END),
    '^([0-9]{4}):([0-9]{2}):([0-9]{2})', '\1-\2-\3') AS taken_at,
  CASE WHEN secs >= 1 THEN
         CASE WHEN round(secs * 10) % 10 = 0 THEN CAST(CAST(round(secs * 10) AS bigint) // 10 AS string) || ' s'
              ELSE printf('%.1f', round(secs * 10) / 10) || ' s' END
       WHEN secs > 0 THEN '1/' || CAST(CAST(greatest(round(1 / secs), 1) AS bigint) AS string) || ' s' END AS shutter,
  CASE WHEN fnumber_n > 0 AND fnumber_d > 0 THEN round(fnumber_n / fnumber_d * 10) / 10
       WHEN apex_aperture_n > 0 AND apex_aperture_d > 0
         THEN round(pow(2.0, apex_aperture_n / apex_aperture_d / 2) * 10) / 10 END AS aperture,
  CASE WHEN coalesce(iso_ratings, iso_speed, rei) > 0 THEN CAST(coalesce(iso_ratings, iso_speed, rei) AS bigint) END AS iso,
  CASE WHEN focal_n > 0 AND focal_d > 0 THEN focal_n / focal_d END AS focal_mm
FROM (SELECT *, CASE WHEN exposure_n IS NOT NULL THEN
                  CASE WHEN exposure_n > 0 AND exposure_d > 0 THEN exposure_n / exposure_d END
                  WHEN apex_shutter_d <> 0 THEN pow(2.0, -(apex_shutter_n / apex_shutter_d)) END AS secs
      FROM exif_raw) e
"""

# Ingest outcomes per photo: every 7th fails, every 11th fails after a success.
CTES["results"] = r"""
SELECT id, 'ok' AS kind, width, height, orientation, camera, lens, taken_at, shutter, aperture, iso, focal_mm,
  'previews/' || CAST(id AS string) || '.jpg' AS preview_path, 'thumbs/' || CAST(id AS string) || '.jpg' AS thumb_path,
  NULL AS err_msg, 1800000000000 + id AS ingested_at FROM exif WHERE id % 7 <> 0
UNION ALL BY NAME
SELECT id, 'error' AS kind, repeat('bad file ', 60) || CAST(id AS string) AS err_msg, 1800000001000 + id AS ingested_at
FROM exif WHERE id % 7 = 0 OR id % 11 = 0
"""

CTES["spans"] = r"""
SELECT *, lead(started_event_id) OVER (PARTITION BY job ORDER BY started_event_id) AS until_event_id FROM ingest_batches
"""

CTES["judged"] = r"""
SELECT e.*, coalesce(e.event_id >= s.started_event_id AND (s.until_event_id IS NULL OR e.event_id < s.until_event_id), false) AS fresh
FROM ingest_events e LEFT JOIN spans s ON e.job = s.job AND e.generation = s.generation
"""

# Every third generation is cancelled while it runs.
CTES["cancels"] = "SELECT job, started_event_id + 40 AS event_id FROM ingest_batches WHERE generation % 3 = 1"

CTES["cancel_spans"] = r"""
SELECT * FROM (
  SELECT job, generation, mark AS started_event_id, lead(mark) OVER w AS until_event_id,
         coalesce(lead(generation IS NULL) OVER w, false) AS ended
  FROM (SELECT job, generation, started_event_id AS mark FROM ingest_batches UNION ALL SELECT job, NULL, event_id FROM cancels) m
  WINDOW w AS (PARTITION BY job ORDER BY mark)
) x WHERE generation IS NOT NULL
"""

CTES["cancel_judged"] = r"""
SELECT e.*, coalesce(e.event_id >= s.started_event_id AND (s.until_event_id IS NULL OR e.event_id < s.until_event_id), false) AS fresh
FROM ingest_events e LEFT JOIN cancel_spans s ON e.job = s.job AND e.generation = s.generation
"""

CTES["labels_now"] = "SELECT id, arg_max(label, (ts, event_id)) AS label FROM label_events GROUP BY id"


def with_ctes(sql: str) -> str:
    """Prefixes a query with the CTEs it needs, directly or through others."""
    needed = set()

    def need(text):
        for word in set(re.findall(r"\w+", text)) & CTES.keys():
            if word not in needed:
                needed.add(word)
                need(CTES[word])

    need(sql)
    parts = [f"{name} AS ({text.strip()})" for name, text in CTES.items() if name in needed]
    return f"WITH {', '.join(parts)} {sql.strip()}" if parts else sql.strip()
