
import json
import sys


def main() -> None:
    d = json.loads(sys.stdin.read().strip().splitlines()[-1])
    items = list(d["queries"].items())
    rows = (len(items) + 2) // 3
    print(f"Sum over the {len(items)} analytic queries: {d['value']:.1f} s; store build "
          f"{d['load_clean_sec']:.1f} s; streaming {', '.join(f'{k} {v:.1f} s' for k, v in d['stream_sec'].items())}.\n")
    print("| query | sec | query | sec | query | sec |")
    print("|---|---|---|---|---|---|")
    for r in range(rows):
        cells = []
        for c in range(3):
            i = c * rows + r
            cells += [items[i][0], f"{items[i][1]:.2f}"] if i < len(items) else ["", ""]
        print("| " + " | ".join(cells) + " |")


if __name__ == "__main__":
    main()
